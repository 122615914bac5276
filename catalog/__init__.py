"""Named queries over the driver's tables, with the same results in DuckDB SQL."""
