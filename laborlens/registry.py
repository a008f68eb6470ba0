"""Every registered query of the library, with the SQL that checks it."""

from __future__ import annotations

from laborlens.plans import analytic, boards, embedding, incremental, neighbours, relational, reparse, sites, text, updates

QUERIES = {**analytic.QUERIES, **relational.QUERIES, **text.QUERIES, **incremental.QUERIES, **embedding.QUERIES, **updates.QUERIES, **boards.QUERIES, **sites.QUERIES, **reparse.QUERIES, **neighbours.QUERIES}
SQL = {**analytic.SQL, **relational.SQL, **text.SQL, **incremental.SQL, **embedding.SQL, **updates.SQL, **boards.SQL, **sites.SQL, **reparse.SQL, **neighbours.SQL}
