"""All queries of the engine, and the SQL that checks them."""

from fathomline.plans import daily_queries, relational, relational_sql, search, stored_queries

QUERIES = {**search.QUERIES, **relational.QUERIES, **daily_queries.QUERIES, **stored_queries.QUERIES}
ORACLE_SQL = {**search.ORACLE_SQL, **relational_sql.ORACLE_SQL, **daily_queries.ORACLE_SQL, **stored_queries.ORACLE_SQL}
