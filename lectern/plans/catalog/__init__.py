"""All registered queries: one key per operator, with SQL where SQL can express it."""

from __future__ import annotations

from lectern.plans.catalog import corpus, quoted, search, store, text
from lectern.session import prepare


def _prepared(query):
    def run(spark, folder):
        return query(prepare(spark), folder)

    return run


flagship = _prepared(search.flagship)
QUERIES = {}
SQL = {}
for part in (corpus, text, search, quoted, store):
    QUERIES.update({name: _prepared(query) for name, query in part.QUERIES.items()})
    SQL.update(part.SQL)
