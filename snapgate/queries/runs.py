"""Run log states and evidence derived from orders and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators import runlog
from snapgate.queries.registry import Tables, query


def _states(t: Tables) -> DataFrame:
    """Two or three run states per order: opened, evaluated and, by status, closed."""
    def state(number: int, status, stage, written) -> F.Column:
        return F.struct(
            F.lit(number).cast("bigint").alias("state_number"), status.alias("status"),
            stage.alias("last_stage"), written.cast("bigint").alias("records_written"),
        )

    finished = F.col("o_orderstatus") == "F"
    closed = state(
        2, F.when(finished, "SUCCEEDED").otherwise("REJECTED"),
        F.when(finished, "COMPLETE").otherwise("QUALITY"),
        F.when(finished, F.floor("o_totalprice")).otherwise(0),
    )
    running = F.lit("RUNNING")
    opened = [
        state(0, running, F.lit("SOURCE"), F.lit(None)),
        state(1, running, F.lit("QUALITY"), F.lit(None)),
    ]
    states = F.when(F.col("o_orderstatus") == "O", F.array(*opened)).otherwise(
        F.array(closed, *opened)
    )
    return t.orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.inline(states),
    )


_RUNS = """
SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'REJECTED' END
           AS status,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' ELSE 'QUALITY' END AS last_stage,
       CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice) AS BIGINT)
                          WHEN 'P' THEN 0 END AS records_written
FROM orders"""


@query(_RUNS)
def run_log_latest(t: Tables) -> DataFrame:
    """The latest state of every run."""
    return runlog.latest_runs(_states(t)).select("run_id", "status", "last_stage", "records_written")


@query(f"""
SELECT run_id, r.status AS run_status, last_stage, rules, failed_rules, blocking_rules
FROM ({_RUNS}) r JOIN (
    SELECT 'run-' || CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS rules,
           count(*) FILTER (WHERE l_discount > 0.05) AS failed_rules,
           count(*) FILTER (WHERE l_discount > 0.05 AND l_returnflag = 'R') AS blocking_rules
    FROM lineitem GROUP BY 1) USING (run_id)
""")
def run_evidence(t: Tables) -> DataFrame:
    """Runs beside the evidence recorded under their id."""
    results = t.lineitem.select(
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.when(F.col("l_discount") > 0.05, "FAIL").otherwise("PASS").alias("status"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("WARNING").alias("severity"),
    )
    return runlog.run_evidence(runlog.latest_runs(_states(t)), results)


@query("""
WITH base AS (
  SELECT 'run-' || o_orderkey AS run_id, o_orderkey % 13 AS kind, n AS state_number,
    CASE n WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'QUALITY' WHEN 2 THEN 'WRITE' ELSE 'COMPLETE' END AS last_stage,
    CASE WHEN n = 3 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status, o_custkey * n AS written
  FROM orders, range(4) AS t(n)),
bent AS (
  SELECT run_id, kind,
    CASE WHEN kind = 6 THEN state_number + 1 ELSE state_number END AS state_number,
    CASE WHEN kind = 3 AND state_number = 1 THEN 'LOAD' WHEN kind = 7 AND state_number = 2 THEN 'SOURCE'
         WHEN kind = 8 AND state_number = 2 THEN 'QUALITY' WHEN kind = 9 AND state_number = 0 THEN 'WRITE'
         WHEN kind = 11 AND state_number = 3 THEN 'QUALITY' ELSE last_stage END AS last_stage,
    CASE WHEN kind = 2 AND state_number = 2 THEN 'FAILED' WHEN kind = 8 AND state_number = 2 THEN 'REJECTED'
         WHEN kind = 10 AND state_number = 3 THEN NULL WHEN kind = 11 AND state_number = 3 THEN 'REJECTED' ELSE status END AS status,
    CASE WHEN kind = 4 AND state_number = 3 THEN -1 ELSE written END AS written
  FROM base WHERE NOT (kind = 1 AND state_number = 2) AND NOT (kind = 8 AND state_number = 3)
  UNION ALL SELECT run_id, kind, state_number, last_stage, status, written FROM base WHERE kind = 5 AND state_number = 1),
ranked AS (
  SELECT *, CASE last_stage WHEN 'SOURCE' THEN 1 WHEN 'QUALITY' THEN 2 WHEN 'WRITE' THEN 3 WHEN 'COMPLETE' THEN 4 ELSE 0 END AS place,
    lag(state_number) OVER w AS prior, count(*) OVER (PARTITION BY run_id, state_number) AS n,
    min(CASE WHEN status <> 'RUNNING' THEN state_number END) OVER (PARTITION BY run_id) AS ended
  FROM bent WINDOW w AS (PARTITION BY run_id ORDER BY state_number)),
moved AS (SELECT *, lag(place) OVER (PARTITION BY run_id ORDER BY state_number) AS was FROM ranked),
seen AS (
  SELECT run_id, state_number, unnest(list_filter([
    CASE WHEN place = 0 OR status IS NULL THEN 'unknown status or stage' END,
    CASE WHEN n > 1 THEN 'number repeated' END,
    CASE WHEN prior IS NULL AND state_number > 0 THEN 'no first state' END,
    CASE WHEN state_number > prior + 1 THEN 'number skipped' END,
    CASE WHEN state_number = 0 AND place > 1 THEN 'not from the source' END,
    CASE WHEN state_number <= prior + 1 AND was > 0 AND place > was + 1 THEN 'stage skipped' END,
    CASE WHEN state_number <= prior + 1 AND place > 0 AND place < was AND coalesce(status, '') <> 'REJECTED' THEN 'stage reversed' END,
    CASE WHEN (status = 'SUCCEEDED') <> (last_stage = 'COMPLETE') OR status = 'REJECTED' AND last_stage <> 'QUALITY'
         THEN 'end at another stage' END,
    CASE WHEN state_number > ended THEN 'state after the end' END,
    CASE WHEN written < 0 THEN 'negative count' END], lambda x: x IS NOT NULL)) AS fault
  FROM moved)
SELECT DISTINCT run_id, state_number, fault FROM seen
""")
def run_transition_faults(t: Tables) -> DataFrame:
    """Stored states that no legal run has; of 13 kinds of runs most are bent in one way."""
    n, kind = F.col("state_number"), F.col("kind")
    base = t.orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        (F.col("o_orderkey") % 13).alias("kind"), "o_custkey",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("state_number"))
    stage = F.element_at(F.array(*[F.lit(str(x)) for x in runlog.Stage]), (n + 1).cast("int"))
    base = base.select("run_id", "kind", "state_number", stage.alias("last_stage"),
                       F.when(n == 3, "SUCCEEDED").otherwise("RUNNING").alias("status"),
                       (F.col("o_custkey") * n).alias("records_written"))

    def at(k: int, number: int) -> F.Column:
        return (kind == k) & (n == number)

    bent = base.where(~at(1, 2) & ~at(8, 3)).select(
        "run_id", F.when(kind == 6, n + 1).otherwise(n).alias("state_number"),
        F.when(at(3, 1), "LOAD").when(at(7, 2), "SOURCE").when(at(8, 2) | at(11, 3), "QUALITY")
        .when(at(9, 0), "WRITE").otherwise(F.col("last_stage")).alias("last_stage"),
        F.when(at(2, 2), "FAILED").when(at(8, 2) | at(11, 3), "REJECTED").when(~at(10, 3), F.col("status")).alias("status"),
        F.when(at(4, 3), -1).otherwise(F.col("records_written")).alias("records_written"))
    twice = base.where(at(5, 1)).select(*bent.columns)
    return runlog.transition_faults(bent.unionByName(twice), ["records_written"])
