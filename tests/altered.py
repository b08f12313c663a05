"""A second set of the test tables: other keys, thinned rows, nulls and ties."""

from pathlib import Path

import duckdb

ALTERED = {
    "supplier": "SELECT * REPLACE ((s_nationkey * 3 + 1) % 25 AS s_nationkey) FROM supplier",
    "customer": "SELECT * REPLACE ((c_nationkey * 7 + 2) % 25 AS c_nationkey) FROM customer WHERE c_custkey % 11 <> 3",
    "part": "SELECT * REPLACE (p_partkey + 5 AS p_partkey, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS p_type) FROM part WHERE p_partkey % 7 <> 2",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '1998-03-02' ELSE o_orderdate END::{o_orderdate} AS o_orderdate) FROM orders WHERE o_orderkey % 3 <> 1",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN 'A' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_orderkey % 3 <> 1",
    "events": "SELECT * REPLACE (date_trunc('hour', ts)::{ts} AS ts, user_id % 7 AS user_id) FROM events WHERE event_id % 5 <> 2",
}


def write(source: Path, target: Path) -> None:
    for f in source.glob("*.parquet"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        kinds = {c[0]: c[1] for c in con.sql(f"DESCRIBE {f.stem}").fetchall()}
        sql = ALTERED.get(f.stem, f"SELECT * FROM {f.stem}")
        for name, kind in kinds.items():
            sql = sql.replace("{" + name + "}", kind)
        rows = con.sql(sql)
        changed = [f'CAST("{c}" AS {kinds[c]}) AS "{c}"' for c in rows.columns]
        rows.select(", ".join(changed)).write_parquet(str(target / f.name))
