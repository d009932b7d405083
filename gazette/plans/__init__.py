"""Named query plans: each key builds a DataFrame from a scale-factor folder
and has (where SQL can say it) an equivalent DuckDB SQL text."""
