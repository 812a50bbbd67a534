"""Registered queries: each is a Spark plan over the driver tables plus the
equivalent DuckDB SQL used as an independent oracle."""
