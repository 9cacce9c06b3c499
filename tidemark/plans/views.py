"""Stand-in inputs derived from the given tables: one SQL text that both engines run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import materialize

BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events", "documents")

CTES = {
    "cal": """SELECT wk AS session_date, CAST(row_number() OVER (ORDER BY wk) AS int) AS idx
              FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS date) AS wk FROM lineitem)""",
    "panel": """SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS date) AS session_date,
                  CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) / sum(l_quantity) AS close, sum(l_quantity) AS vol,
                  CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS double) AS amount,
                  sum(l_quantity) / (100 + l_suppkey) AS turnover,
                  CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) / sum(l_quantity) / (1 + l_suppkey % 7) AS pe
                FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS date)""",
    "px": "SELECT p.*, c.idx FROM panel p JOIN cal c ON p.session_date = c.session_date",
    "bench": """SELECT CAST(date_trunc('week', l_shipdate) AS date) AS session_date, CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) / sum(l_quantity) AS close
                FROM lineitem GROUP BY CAST(date_trunc('week', l_shipdate) AS date)""",
    # quotes with gaps in prices and factors, and halts: the first is read from the panel, the other from events
    "quotes": """SELECT code, idx, CASE WHEN (code * 3 + idx) % 41 = 0 THEN 0 ELSE close END AS raw, CASE WHEN (code + idx) % 37 = 0 THEN NULL WHEN idx > 180 AND code % 7 = 0 THEN 2.0E0 ELSE 1.0E0 END AS factor
                 FROM px WHERE code % 31 <> 0""",
    "halts": """SELECT DISTINCT CAST(1 + (user_id * 7 + event_id) % n AS bigint) AS code, CAST(100 + (day(ts) * 24 + hour(ts)) % 257 AS int) AS idx, CASE WHEN event_id % 4 = 0 THEN 'R' ELSE 'S' END AS kind
                FROM events, (SELECT count(*) AS n FROM supplier) s""",
    "as_of": """SELECT min(session_date) AS as_of, min(idx) AS idx FROM cal WHERE idx >= 100 GROUP BY year(session_date), quarter(session_date)""",
    "q_flow": """SELECT c_nationkey AS code, CAST(year(o_orderdate) AS int) AS yr, CAST(quarter(o_orderdate) AS int) AS q,
                  sum(CAST(o_totalprice AS decimal(18,2))) AS r, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS decimal(18,2)) ELSE 0 END) AS f
                FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)""",
    "q_cum": """SELECT code, yr, q, CAST(sum(r) OVER w AS double) AS revenue,
                  0.1 * CAST(sum(f) OVER w AS double) - 0.02 * CAST(sum(r - f) OVER w AS double) AS profit
                FROM q_flow WINDOW w AS (PARTITION BY code, yr ORDER BY q)""",
    "q_first": """SELECT code, yr, q, yr * 4 + q - 1 AS pn, CAST(make_date(yr, q * 3, CASE WHEN q IN (1, 4) THEN 31 ELSE 30 END) AS date) AS end_date, revenue, profit
                  FROM q_cum WHERE (code * 13 + yr * 4 + q) % 17 <> 0""",
    "income": """SELECT code, yr, q, pn, end_date, CAST(end_date + CAST(20 + (code * 7 + q * 3) % 40 AS int) AS date) AS ann_date, 0 AS update_flag, revenue, profit FROM q_first
                 UNION ALL SELECT code, yr, q, pn, end_date, CAST(end_date + CAST(80 + (code * 7 + q * 3) % 40 AS int) AS date), 1, revenue * 1.05, profit * 1.05 FROM q_first WHERE (code + yr + q) % 5 = 0""",
    "statements": """SELECT code, yr, q, pn, end_date, ann_date, update_flag, revenue, profit, 0.3 * revenue AS gross, 1.2 * profit AS operating,
                       profit * (0.5 + (code % 4) / CAST(4 AS double)) - CASE WHEN (code + q) % 5 = 0 THEN 0.12 * revenue ELSE 0 END AS cfo,
                       10 * revenue AS assets, 4 * revenue AS equity, 0.2 * revenue * (1 + q % 3) AS inventories, 0.1 * revenue * (1 + (code + q) % 2) AS receivables FROM income""",
    # simultaneous reports: the parent's own, with and without a flag, another basis, unit or duration in some years, and a second version on the same day
    "filings": """SELECT code, yr, q, pn, end_date, ann_date AS available, CASE WHEN code % 5 <> 0 THEN CAST(ann_date - CAST(code % 2 AS int) AS date) END AS notice, CAST(f AS varchar(1)) AS update_flag, ord,
                    CASE WHEN own = 1 THEN '6' WHEN code % 9 = 4 AND yr % 4 = 2 THEN '2' WHEN code % 4 <> 3 THEN '1' END AS report_type,
                    CASE WHEN code % 9 = 4 AND yr % 4 = 2 AND own = 0 THEN 'SINGLE_QUARTER' WHEN code % 17 = 5 AND q = 3 THEN 'UNKNOWN' ELSE 'CUMULATIVE_YTD' END AS duration,
                    CASE WHEN code % 8 = 6 AND yr % 3 = 1 THEN 'raw:group' ELSE 'source_default' END AS report_family, 'INCOME_STATEMENT' AS statement_type,
                    CASE WHEN own = 1 THEN 'parent_only' WHEN code % 10 = 7 AND pn % 7 = 1 THEN 'source_default' ELSE 'consolidated' END AS scope,
                    CASE WHEN code % 10 = 3 AND yr % 5 = 2 THEN 'cny:1000' ELSE 'cny:1' END AS unit, CASE WHEN code % 12 = 8 AND yr >= 1999 THEN 'raw:ifrs' ELSE 'source_default' END AS accounting,
                    CASE WHEN code % 11 = 2 AND q = 2 THEN CAST(NULL AS double) ELSE revenue * x END AS revenue, profit * x AS profit
                  FROM (SELECT i.*, 0 AS own, CASE WHEN (code + q) % 7 = 0 AND update_flag = 0 THEN NULL ELSE update_flag END AS f, 1 AS ord, 1.0 AS x FROM income i
                        UNION ALL SELECT i.*, 1, update_flag, 2, 0.4 FROM income i WHERE code % 6 = 0
                        UNION ALL SELECT i.*, 0, NULL, 3, 0.9 FROM income i WHERE (code + yr + q) % 9 = 0 AND update_flag = 0) z""",
    # three statements of each report: some lack the cash flow or have another basis in one of them, some values are null or zero
    "filed": """SELECT f.code, f.pn, f.end_date, f.available, f.notice, f.update_flag, f.ord, f.report_type, d.dataset, CASE WHEN d.dataset = 'balancesheet' THEN 'POINT_IN_TIME' ELSE f.duration END AS duration, f.report_family,
                  CASE WHEN d.dataset = 'income' THEN f.statement_type ELSE upper(d.dataset) END AS statement_type, CASE WHEN d.dataset = 'cashflow' AND f.code % 10 = 1 AND f.pn % 6 = 2 THEN 'source_default' ELSE f.scope END AS scope,
                  CASE WHEN d.dataset = 'balancesheet' AND f.code % 9 = 2 THEN 'cny:10000' ELSE f.unit END AS unit, f.accounting,
                  CASE WHEN d.dataset = 'income' THEN revenue END AS revenue, CASE WHEN d.dataset = 'income' THEN profit END AS profit, CASE WHEN d.dataset = 'income' THEN 0.3 * revenue END AS gross, CASE WHEN d.dataset = 'income' THEN 1.2 * profit END AS operating,
                  CASE WHEN d.dataset = 'cashflow' THEN profit * (0.5 + (f.code % 4) / CAST(4 AS double)) - CASE WHEN (f.code + f.pn) % 5 = 0 THEN 0.12 * revenue ELSE 0 END END AS cfo,
                  CASE WHEN d.dataset = 'balancesheet' THEN 10 * revenue END AS assets, CASE WHEN d.dataset = 'balancesheet' THEN CASE WHEN f.code % 13 = 3 THEN 0 ELSE 4 * revenue END END AS equity,
                  CASE WHEN d.dataset = 'balancesheet' THEN 0.2 * revenue * (1 + f.pn % 3) END AS inventories, CASE WHEN d.dataset = 'balancesheet' AND f.code % 15 <> 4 THEN 0.1 * revenue * (1 + (f.code + f.pn) % 2) END AS receivables
                FROM filings f CROSS JOIN (SELECT 'income' AS dataset UNION ALL SELECT 'cashflow' UNION ALL SELECT 'balancesheet') d WHERE d.dataset = 'income' OR (f.code + f.pn) % 11 <> CASE WHEN d.dataset = 'cashflow' THEN 3 ELSE 4 END""",
    # nested payloads, parts of which many entities share
    "payloads": """SELECT s_suppkey AS code, n_name AS nation, r_name AS region, '{"entity":{"code":' || CAST(s_suppkey AS varchar(20)) || ',"nation":{"name":"' || n_name || '","region":{"name":"' || r_name || '"}}},"lines":[{"flag":"A","n":' || CAST(a AS varchar(20)) || '},{"flag":"N","n":' || CAST(nn AS varchar(20)) || '},{"flag":"R","n":' || CAST(r AS varchar(20)) || '}]}' AS payload, a, nn, r
                 FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
                 JOIN (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) % 5 AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) % 5 AS nn, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 5 AS r FROM lineitem GROUP BY l_suppkey) z ON l_suppkey = s_suppkey""",
    "ref": """SELECT s_suppkey AS code, CASE WHEN s_suppkey % 11 = 0 THEN 60 ELSE 1 END AS list_idx, CASE WHEN s_suppkey % 23 = 0 THEN 250 END AS delist_idx,
                CASE WHEN s_suppkey % 19 = 0 THEN 'ST' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 29 = 0 THEN '.BJ' ELSE '.SH' END AS board, s_nationkey AS industry FROM supplier""",
}


def with_views(sql: str) -> str:
    """SQL over the stand-ins, with those that it needs in front. SQL may begin with a comma and more of its own."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\w+", text)) & CTES.keys() - found:
            found.add(name)
            visit(CTES[name])

    visit(sql)
    front = ",\n".join(f"{k} AS ({v})" for k, v in CTES.items() if k in found)
    if not front:
        return "WITH " + sql.lstrip().removeprefix(",") if sql.lstrip().startswith(",") else sql
    return f"WITH {front}\n{sql}"


class Views:
    """The stand-ins and given tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}
        self._keeping = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def run(self, sql: str) -> DataFrame:
        """A query over the stand-ins."""
        for b in BASE:
            self.table(b).createOrReplaceTempView(b)
        return self.spark.sql(with_views(sql))

    def keep(self, *names: str) -> Views:
        """Writes stand-ins that a query reads several times, once; they and what once() is asked for are then read back."""
        self._keeping = True
        for name in names:
            if name not in self.__dict__:
                setattr(self, name, materialize(getattr(self, name), name))
        return self

    def once(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step that several parts of a query share: written once if the query keeps what it reads."""
        if not self._keeping:
            return make()
        if label not in self._stored:
            self._stored[label] = materialize(make(), label)
        return self._stored[label]

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """A result that is read several times, written once."""
        return materialize(df, label)

    def over(self, px: DataFrame, name: str) -> DataFrame:
        """A stand-in that reads the panel, over a panel that is at hand."""
        px.createOrReplaceTempView("px")
        return self.spark.sql(CTES[name])

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name) if name in BASE else self.run(f"SELECT * FROM {name}")
