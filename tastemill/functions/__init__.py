from tastemill.functions.core import (  # noqa: F401
    hash_key, split_bucket, safe_div, r6, top_n, parse_genres, snippet,
    pick_columns, dense_positions,
)
