"""The given tables as the archive's tables, and the same bindings as SQL for the checks.

Each binding is a view: column expressions over a scan, so filters and pruning reach the files.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 1 << 19  # lines that a task sorts and adds up by proposal

NOW = "2024-01-31 00:00:00"

#: Spark SQL and DuckDB read these alike. Order matters: later ones use earlier ones.
SQL = {
    "proposals": """
        SELECT o_orderkey AS proposal_id, o_custkey AS company_id, o_orderpriority AS category,
               CASE o_orderstatus WHEN 'F' THEN 'evaluated' WHEN 'O' THEN 'queued' ELSE
                   CASE o_orderkey % 4 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'skipped' ELSE 'failed' END END AS status,
               o_orderstatus = 'F' AS is_evaluated,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN 'approved_for_eval' WHEN o_orderkey % 4 = 2 THEN 'skipped_duplicate' ELSE 'pending' END AS review_decision,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000 END AS latest_score,
               CASE WHEN o_orderstatus = 'F' THEN 'Recommended' END AS latest_recommendation, CASE WHEN o_orderstatus = 'F' THEN 'run of old' END AS latest_evaluation_id,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS evaluated_at, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 30) AS updated_at,
               CAST(floor(o_totalprice % 90) AS INT) AS total_pages, CAST(o_orderkey * 7919 % 20000 AS INT) AS total_words,
               concat('Stock of ', o_orderpriority, ' runs out in district ', CAST(o_custkey % 25 AS STRING)) AS problem_statement,
               CAST(o_orderkey % 5 AS INT) AS retry_count,
               CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 4 = 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 'extraction' WHEN 1 THEN 'metadata' END END AS error_stage,
               CAST(o_custkey % 50 AS INT) AS batch_id,
               concat('Proposal ', CAST(o_orderkey AS STRING)) AS title,
               concat('file_', CAST(o_orderkey % 1000 AS STRING), '.pdf') AS filename
        FROM orders""",
    "companies": "SELECT c_custkey AS company_id, c_name AS name FROM customer",
    "decisions": """
        SELECT l_orderkey AS proposal_id,
               CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE CASE WHEN l_linestatus = 'F' THEN 'selected_for_funding' ELSE 'unselected' END END AS decision,
               l_shipdate AS decided_at, o_custkey AS company_id, o_orderpriority AS category, l_partkey AS part_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1""",
    "evaluations": """
        SELECT l_orderkey AS proposal_id,
               CASE WHEN l_returnflag IN ('A', 'N') THEN 'completed' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'processing' END AS status,
               round(l_discount * 1000, 2) AS score, CAST(floor(l_extendedprice) AS BIGINT) AS tokens, CAST(floor(l_quantity * 10000) AS BIGINT) AS duration_ms,
               CASE l_suppkey % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END AS model,
               round(l_tax * 10, 2) AS coverage, l_shipdate AS created_at, CASE WHEN l_partkey % 4 > 0 THEN l_shipdate + INTERVAL 1 DAY * (l_suppkey % 3) END AS completed_at,
               CASE WHEN l_discount >= 0.08 THEN 'Highly Recommended' WHEN l_discount >= 0.05 THEN 'Recommended' ELSE 'Not Recommended' END AS recommendation,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS run_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id
        FROM lineitem""",
    "answers": """
        SELECT proposal_id, parameter, question, raw_score, evidenced, red_flag FROM (
            SELECT l_orderkey AS proposal_id, l_linenumber AS parameter, CAST(l_partkey % 5 AS INT) AS question,
                   round(l_discount * 100, 2) AS raw_score, l_returnflag <> 'N' AS evidenced, l_tax >= 0.08 AS red_flag,
                   row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey % 5 ORDER BY l_discount DESC, l_returnflag, l_tax, l_partkey, l_quantity) AS place
            FROM lineitem) AS a WHERE place = 1""",
    "failed_parameters": "SELECT DISTINCT l_orderkey AS proposal_id, l_linenumber AS parameter FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
    "job_events": """
        SELECT event_id, user_id AS job_id, ts,
               CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'succeed' ELSE 'fail' END AS event,
               value
        FROM events""",
    "calls": "SELECT event_id, event_type AS model, ts, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events",
}
_DEPENDS = {name: [n for n in SQL if n != name and re.search(rf"\b{n}\b", text)] for name, text in SQL.items()}


def with_bindings(sql: str) -> str:
    """A query for the checks, with those bindings in front that it names."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} AS ({SQL[n].replace('AS STRING', 'AS VARCHAR')})" for n in used)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head}, {body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


class Archive:
    """The archive over one folder of tables; each table is a lazy scan or view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str, **instead: DataFrame) -> DataFrame:
        """A binding; ``instead``: other frames, such as streams, in place of given tables."""
        given = {n: instead.get(n) if n in instead else self.table(n) for n in ("orders", "lineitem", "customer", "events") if re.search(rf"\b{n}\b", SQL[name])}
        text = re.sub(r"\b(orders|lineitem|customer|events)\b", r"{\1}", SQL[name])
        return self.spark.sql(text, **given)

    @cached_property
    def proposals(self) -> DataFrame:
        return self.view("proposals")

    @cached_property
    def companies(self) -> DataFrame:
        return self.view("companies")

    @cached_property
    def categories(self) -> DataFrame:
        """category, label: the five kinds that proposals name."""
        rows = [(c, c.split("-", 1)[1].title()) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
        return self.spark.createDataFrame(rows, "category string, label string")

    @cached_property
    def decisions(self) -> DataFrame:
        return self.view("decisions")

    @cached_property
    def evaluations(self) -> DataFrame:
        return self.view("evaluations")

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem dealt by order, ROWS_A_TASK lines to a task, whatever the size of files and of the shuffle's partitions.

        Answers are ranked, added up and joined by keys that begin with the order, so these steps move no rows again and a task's memory doesn't grow with the table.
        """
        rows = self.table("lineitem")
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), "l_orderkey")

    @cached_property
    def answers(self) -> DataFrame:
        return self.view("answers", lineitem=self.lines)

    @cached_property
    def failed_parameters(self) -> DataFrame:
        return self.view("failed_parameters", lineitem=self.lines)

    @cached_property
    def job_events(self) -> DataFrame:
        return self.view("job_events")

    @cached_property
    def calls(self) -> DataFrame:
        return self.view("calls")

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("company"), F.col("embedding").alias("vec"))
