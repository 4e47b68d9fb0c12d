"""All registered queries by key: (query, SQL counterpart or None)."""

from evigraph.plans import queries_model, queries_more, queries_serving, queries_text, queries_weights

QUERIES = {
    **queries_weights.QUERIES, **queries_text.QUERIES, **queries_serving.QUERIES, **queries_model.QUERIES, **queries_more.QUERIES,
}
