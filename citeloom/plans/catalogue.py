"""All queries of the core and their SQL."""

from . import building, older, scoring

QUERIES = {**building.QUERIES, **scoring.QUERIES, **older.QUERIES}
SQL = {**building.SQL, **scoring.SQL, **older.SQL}
