"""Part of fluxspan."""
