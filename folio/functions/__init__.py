"""Part of folio."""
