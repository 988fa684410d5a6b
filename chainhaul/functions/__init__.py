"""Part of chainhaul."""
