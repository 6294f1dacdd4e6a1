"""Operators of a training-data pipeline (language ID, toxicity, near
duplicates, decontamination, packing, token files, WARC, extraction, sharding,
top-k search). ``queries.QUERIES`` holds the registered queries and
``queries.ORACLE`` their DuckDB SQL; nothing outside this subpackage imports
it."""
