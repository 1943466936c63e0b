"""Registered queries: each module has QUERIES (name -> function of session and folder) and ORACLE (name -> DuckDB SQL)."""
