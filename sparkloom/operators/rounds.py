"""Budgeted scans and resumable rounds.

`budgeted` says which candidates a sequential scan takes that stops at a budget of new fetches or a number of successes, and why it stops.
The counts at a row are running sums over the rows before it. They never fall, so where the scan stops is a filter and not a loop; the sums come from `prefix_sums`,
which deals rows out by ranges of task and order, so a task with a third of all rows is spread over a third of the tasks and only its sums meet.

`Ledger` keeps what stages have done, by stage, round and task, in a folder that all executors share. A stage's rows and tasks are written first and count once its one commit
row is there. A run that is killed goes on at the first stage without a commit; tasks that have done a stage are not given to it again, and tasks that come later are.

`drain` and `gap_rounds` are loops over a ledger: batches of parsing until a target, no progress or the end; and search, choice, reading and coverage until
the required slots of a task are covered, nothing new is found or the rounds are over. Their state lives in the ledger's tables; the driver keeps the round number. What a stage is given depends on
committed rows only, so the same rounds come out however often a run is killed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.coverage import slot_status
from sparkloom.session import scratch


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with <name>_before for each value: the sum over the key's earlier rows, 0 for the first. order (columns, ascending) must be total in a key."""
    spark = rows.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(values)
    dealt = rows.withColumns({f"_v_{n}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in values.items()})
    dealt = dealt.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    path = scratch(spark, "prefix")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    here = {k: f"_k_{i}" for i, k in enumerate(keys)}
    sums = dealt.groupBy(*[F.col(k).alias(n) for k, n in here.items()], F.col("_part").alias("_p")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    earlier = Window.partitionBy(*here.values()).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part that a key lies in
    sums = sums.select(*here.values(), "_p", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    met = F.col("_part") == F.col("_p")
    for k, n in here.items():
        met = met & F.col(k).eqNullSafe(F.col(n))
    both = counted.join(sums, met)
    return both.select(*rows.columns, *[(F.col(f"_e_{n}") + F.col(f"_i_{n}")).alias(f"{n}_before") for n in names])


def budgeted(candidates: DataFrame, keys: list[str], order: list[str], limit: int, target: int | None = None, least_authoritative: int = 0) -> DataFrame:
    """candidates with `taken`. candidates: keys, order and the booleans existing (fetched before: read, but not paid for), success, authoritative.
    With a target the scan ends at so many successes, but goes on while fewer than least_authoritative of them are authoritative and such candidates are left. Null flags are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    values = {"created": ~flag("existing"), "successes": flag("success"), "authoritative_successes": flag("success") & flag("authoritative"), "authoritative": flag("authoritative")}
    summed = prefix_sums(candidates, keys, order, values)
    total = summed.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.count_if(flag("authoritative")).alias("_all"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    summed = summed.join(total, met).drop(*[f"_t_{k}" for k in keys])
    taken = F.col("created_before") < limit
    if target is not None:
        waits = (F.col("authoritative_successes_before") < least_authoritative) & (F.col("authoritative_before") < F.col("_all"))
        taken = taken & ((F.col("successes_before") < max(target, 1)) | waits)
    return summed.withColumn("taken", taken).drop("_all", "authoritative_before", "authoritative_successes_before")


def budget_summary(scanned: DataFrame, keys: list[str], limit: int, target: int | None = None) -> DataFrame:
    """What each key's scan did and why it stopped."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    new, taken = F.col("taken") & ~flag("existing"), F.col("taken")
    out = scanned.groupBy(*keys).agg(
        F.count_if(new).alias("created"), F.count_if(taken & flag("existing")).alias("skipped_existing"), F.count_if(new & flag("success")).alias("succeeded"), F.count_if(new & ~flag("success")).alias("failed"),
        F.count_if(taken & flag("success")).alias("successes"), F.count_if(~taken).alias("unattempted"),
        (F.count_if(taken & (F.col("successes_before") >= max(target, 1))) if target is not None else F.lit(0).cast("long")).alias("continued"),
    )
    met = F.col("successes") >= max(target, 1) if target is not None else F.lit(False)
    reason = F.when(F.col("unattempted") == 0, "no_unattempted_candidates").when(F.col("created") >= limit, "fetch_budget_exhausted").when(met, "success_target_met").otherwise("unknown_early_exit")
    return out.withColumn("stop_reason", reason)


class Ledger:
    """Stages done, in a folder: commits (stage, round, folder), and in each folder the stage's rows and its tasks."""

    COMMITS = "stage string, round int, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self, stage: str, round_no: int) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        found = self.spark.read.schema(self.COMMITS).parquet(f"{self.path}/commits").where((F.col("stage") == stage) & (F.col("round") == round_no))
        return sorted(r["folder"] for r in found.collect())  # a row each time that a stage ran

    def run(self, stage: str, round_no: int, tasks: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows of all tasks in this round. work gets the tasks (task_id) that haven't done it and returns rows, with task_id among their columns."""
        done = self.commits(stage, round_no)
        pending = tasks.select("task_id").distinct()
        if done:
            pending = pending.join(self.spark.read.parquet(*[f"{f}/tasks" for f in done]), "task_id", "left_anti")
        folder = f"{self.path}/{stage}-{round_no}-{uuid.uuid4().hex}"
        pending.write.parquet(f"{folder}/tasks")
        pending = self.spark.read.schema(pending.schema).parquet(f"{folder}/tasks")
        if not pending.isEmpty() or not done:
            work(pending).write.parquet(f"{folder}/rows")
            self.spark.createDataFrame([(stage, round_no, folder)], self.COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
            done.append(folder)
        return self.spark.read.parquet(*[f"{f}/rows" for f in done])


def drain(ledger: Ledger, rows: DataFrame, order: list[str], work: Callable[[DataFrame], DataFrame], batch: int, max_batches: int, target: int | None = None, max_seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Work through each task's rows in batches of `batch` until max_batches or max_seconds, target created rows, a batch that creates nothing, or the end.
    rows: task_id, order; work gets a batch of all active tasks and returns task_id, created (boolean) and what else it likes. Returns its rows with batch_no, and per task
    batches, created, left (rows not worked on) and stop_reason; what is fully drained says so whatever stopped it."""
    began = time.monotonic()
    tasks = rows.select("task_id").distinct()
    number = (F.floor(F.col("one_before") / batch) + 1).cast("int")
    dealt = ledger.run("deal", 0, tasks, lambda pending: prefix_sums(rows.join(pending, "task_id", "left_semi"), ["task_id"], order, {"one": F.lit(1)}).withColumn("batch_no", number).drop("one_before"))
    last = dealt.groupBy("task_id").agg(F.max("batch_no").alias("last"), F.count("*").alias("rows"))
    out, state, active = None, None, tasks
    for b in range(1, max_batches + 1):
        now = dealt.where(F.col("batch_no") == b)
        made = ledger.run("batch", b, active, lambda pending, now=now: work(now.join(pending, "task_id", "left_semi")))
        made = made.withColumn("batch_no", F.lit(b))
        late = max_seconds is not None and time.monotonic() - began >= max_seconds

        def tally(pending: DataFrame, b=b, made=made, state=state, late=late) -> DataFrame:
            counted = made.groupBy("task_id").agg(F.count_if("created").alias("new"))
            worked = dealt.where(F.col("batch_no") <= b).groupBy("task_id").agg(F.count("*").alias("worked"))
            own = pending.join(last, "task_id").join(counted, "task_id", "left").join(worked, "task_id").withColumn("new", F.coalesce("new", F.lit(0)))
            before = own.join(state.select("task_id", F.col("created").alias("was")), "task_id", "left") if state is not None else own.withColumn("was", F.lit(0).cast("long"))
            created = F.coalesce("was", F.lit(0)) + F.col("new")
            reached = created >= target if target is not None else F.lit(False)
            reason = (
                F.when(F.col("last") <= b, "fully_drained").when(F.lit(b >= max_batches), "max_batches").when(F.lit(late), "max_seconds").when(reached, "target_documents").when(F.col("new") == 0, "no_progress")
            )
            return before.select("task_id", F.lit(b).alias("batches"), created.alias("created"), (F.col("rows") - F.col("worked")).alias("left"), reason.alias("stop_reason"))

        state = ledger.run("tally", b, active, tally)
        ends = state.where("stop_reason is not null")
        out = (made, ends) if out is None else (out[0].unionByName(made), out[1].unionByName(ends))
        active = state.where("stop_reason is null").select("task_id")
        if active.isEmpty():
            break
    return out


def gap_rounds(
    ledger: Ledger, slots: DataFrame, search: Callable[[int, DataFrame], DataFrame], read: Callable[[int, DataFrame], DataFrame], max_rounds: int, budget: int, slots_a_round: int,
) -> tuple[DataFrame, DataFrame]:
    """Research rounds to a fixpoint. slots: task_id, slot_id, required. In a round each open task asks for its first slots_a_round required slots that aren't covered:
    search(round, slots) gives task_id, slot_id, source_id, rank; sources that the slot has had are left out, and the budget's best go on; read(round, chosen) gives task_id, slot_id, source_id, relation.
    Returns slots with supported, weak and status, and tasks with rounds, sources and stop_reason (covered, no_new_sources or max_rounds)."""
    tasks = slots.select("task_id").distinct()
    kept, ends, active = None, None, tasks

    def coverage(evidence: DataFrame | None) -> DataFrame:
        if evidence is None:
            return slots.select("*", F.lit(0).cast("long").alias("supported"), F.lit(0).cast("long").alias("weak"))
        n = lambda r: F.count_if(F.col("relation") == r)
        counted = evidence.groupBy("task_id", "slot_id").agg(n("support").alias("supported"), n("weak_support").alias("weak"))
        return slots.join(counted, ["task_id", "slot_id"], "left").na.fill(0, ["supported", "weak"])

    with_status = lambda df: df.withColumn("status", slot_status(F.col("supported"), F.col("weak"), F.lit(0), F.col("required")))
    for r in range(1, max_rounds + 1):
        seen = kept
        place = F.row_number().over(Window.partitionBy("task_id").orderBy("slot_id"))

        def ask(pending: DataFrame, r=r, seen=seen, place=place) -> DataFrame:
            open_ = with_status(coverage(seen)).where("required and status <> 'covered'").join(pending, "task_id", "left_semi")
            asked = open_.withColumn("_n", place).where(F.col("_n") <= slots_a_round).select("task_id", "slot_id")
            found = search(r, asked).select("task_id", "slot_id", "source_id", "rank")
            if seen is not None:
                found = found.join(seen.select("task_id", "slot_id", "source_id"), ["task_id", "slot_id", "source_id"], "left_anti")
            best = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("rank"), "source_id", "slot_id"))
            return found.withColumn("_n", best).where(F.col("_n") <= budget).drop("_n")

        chosen = ledger.run("search", r, active, ask)
        evidence = ledger.run("read", r, active, lambda pending, r=r, chosen=chosen: read(r, chosen.join(pending, "task_id", "left_semi")).select("task_id", "slot_id", "source_id", "relation"))
        kept = evidence if kept is None else kept.unionByName(evidence)

        def judge(pending: DataFrame, r=r, now=kept, chosen=chosen) -> DataFrame:
            open_ = with_status(coverage(now)).where("required and status <> 'covered'").groupBy("task_id").agg(F.count("*").alias("open"))
            fresh = chosen.groupBy("task_id").agg(F.count("*").alias("new"))
            own = pending.join(open_, "task_id", "left").join(fresh, "task_id", "left").na.fill(0, ["open", "new"])
            reason = F.when(F.col("open") == 0, "covered").when(F.col("new") == 0, "no_new_sources").when(F.lit(r >= max_rounds), "max_rounds")
            return own.select("task_id", F.lit(r).alias("rounds"), "open", "new", reason.alias("stop_reason"))

        judged = ledger.run("judge", r, active, judge)
        ended = judged.where("stop_reason is not null").select("task_id", "rounds", "open", "stop_reason")
        ends = ended if ends is None else ends.unionByName(ended)
        active = judged.where("stop_reason is null").select("task_id")
        if active.isEmpty():
            break
    sources = kept.groupBy("task_id").agg(F.count_distinct("source_id").alias("sources"))
    return with_status(coverage(kept)), ends.join(sources, "task_id", "left").na.fill(0, ["sources"])
