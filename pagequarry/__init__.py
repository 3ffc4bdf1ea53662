"""Raw web pages to structured tables, as DataFrame expressions."""
