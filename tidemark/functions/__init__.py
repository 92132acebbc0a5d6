from tidemark.functions.normal import as_ts, code, ident, label, micros, pick, table

__all__ = ["as_ts", "code", "ident", "label", "micros", "pick", "table"]
