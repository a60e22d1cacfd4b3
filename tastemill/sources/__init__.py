from tastemill.sources.tables import (  # noqa: F401
    read_table, scan_catalog_csv, catalog, feedback, vectors, interactions,
    runs, regression_rows, corpus, queries_table, turns, rule_texts, write_recs,
    COMPONENT_OF_EVENT, RATING_OF_EVENT, PRIORITY_CODE,
)
