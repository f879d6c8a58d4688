"""Jobs made of several transforms: imports, sheets, reports."""
