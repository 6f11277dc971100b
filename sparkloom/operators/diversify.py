"""Greedy choice of varied claims by task, without ever gathering a task's candidates.

The ladder of a task (`ladder` below) chooses up to `limit` candidates: for deployment tasks the candidate that adds most open slots, again and again,
then one for each required marker; for technical tasks up to two normalised repository statements, one per official role, then open slots; for tasks that
compare or explain, one per document; then one of each expected category, then the best of other paragraphs, then whatever is best. A candidate whose semantic
key is taken by another identity is a near duplicate: it is passed over and counted at each attempt.

Every step takes the first candidate of one list (a facet, in an order that doesn't depend on earlier choices, or that depends on them only
through which slots are open) that isn't blocked. At most `limit` choices block others: by their key, by their semantic key if the identity
differs, by their paragraph, by their document. So of a facet only these rows can ever be chosen, and the ladder on them alone gives the same choice:
- the first `limit` rows of each (semantic key, identity, paragraph), as only choices bar a row of a place that is open;
- of a semantic key, the first row of each of its first `limit` paragraphs, as at most `limit` - 1 are used; and of the identities of these rows, which alone
  can hold the key, the first `limit` paragraphs too;
- of a paragraph, the first `limit` semantic keys, as at most `limit` - 1 are held;
- the first `limit` ** 2 + `limit` semantic keys, as those before it are held or stand first in a used paragraph.
That is for lists whose first rows are much alike. Tasks of up to 4 * `limit` ** 2 candidates are kept whole, and of a list whose first so many rows hold 2 * `limit` - 1 with
semantic keys and paragraphs of their own, only these rows can be chosen.
Where one candidate of each document is wanted, documents take the paragraphs' part. Lists that aren't read past a row that can't be added keep their first `limit` + 1 rows.
Slots count as a facet per set of slots, as rows with equal slots keep their order. These are windows cut to a few rows, which Spark limits before the shuffle,
so a task with a third of all candidates is no hot group, and what reaches the ladder is bounded by the limit and the number of facets.

What the reduction drops still counts as near duplicates. The ladder says for each step how far it read; candidates in conflict with a choice (joined by semantic key)
are counted against those steps.

candidates: task_id, position (unique in the task, from 1: the order of quality), semantic_key, identity, paragraph, document, category, role,
slots (array of strings), markers and exact_markers (arrays of numbers: groups that the statement or excerpt matches, and those that the excerpt does), code, relevant, role_allowed, normalized
(booleans), source_quality, answer_score, final_score. tasks: task_id, kind (deployment, technical or null), slots (in their order, 60 at most), n_markers, roles,
categories, balanced. Defined cases: null flags are false, null scores 0, null texts their own value; tasks without candidates give no row of choice and zero
near duplicates; candidates without a task are ignored; other columns are not read, and the choice carries task_id and position to join by.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkloom.session import scratch

FLAGS, SCORES, TEXTS = ("code", "relevant", "role_allowed", "normalized"), ("source_quality", "answer_score", "final_score"), ("semantic_key", "identity", "paragraph", "document", "category", "role")
REPOSITORY = "official_repository"
NO_TEXT = "\u0000"
STOP = ("k0", "k1", "k2", "k3", "k4")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prepared(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates with their task's terms and their slots as bits."""
    terms = tasks.select("task_id", "kind", F.col("slots").alias("slot_order"), "roles", "categories", "n_markers", F.coalesce("balanced", F.lit(False)).alias("balanced"))
    own = candidates.select(
        "task_id", F.col("position").cast("long").alias("position"), "slots", F.coalesce("markers", F.array().cast("array<int>")).alias("markers"), F.coalesce("exact_markers", F.array().cast("array<int>")).alias("exact_markers"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SCORES], *[F.coalesce(F.col(c).cast("string"), F.lit(NO_TEXT)).alias(c) for c in TEXTS],
    )
    # A paragraph is its document's. What is only compared is kept as a digest of 128 bits, however long it is.
    own = own.withColumn("paragraph", F.concat("document", F.lit("\u0001"), "paragraph")).withColumns({c: F.unhex(F.md5(c)) for c in ("semantic_key", "identity", "paragraph", "document")})
    joined = own.join(terms, "task_id")
    bit = F.transform(F.coalesce("slot_order", F.array().cast("array<string>")), lambda s, i: F.when(F.array_contains(F.coalesce("slots", F.array().cast("array<string>")), s), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return joined.withColumn("bits", F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a + b)).drop("slots", "slot_order")


def _key(*parts: Column) -> Column:
    """A sort key: four numbers and the position."""
    numbers = [p.cast("double") for p in parts] + [F.lit(0.0)] * (4 - len(parts))
    return F.struct(*[n.alias(STOP[i]) for i, n in enumerate(numbers)], F.col("position").cast("double").alias("k4"))


def marker_key(marker: Column) -> Column:
    return _key((~F.array_contains("exact_markers", marker)).cast("int"), (~F.col("code")).cast("int"), -F.col("source_quality"), -F.col("final_score"))


def role_key() -> Column:
    return _key((~F.col("relevant")).cast("int"), -F.col("answer_score"), -F.col("final_score"))


def facets(rows: DataFrame) -> DataFrame:
    """A row for each list that a candidate stands in: (task_id, facet, key, semantic_key, identity, place, position). The place is what a choice bars to others: the paragraph, or
    the document where one of each document is wanted."""
    here, plain = lambda name, key: F.struct(name.alias("facet"), key.alias("key")), _key()
    some = lambda c, x: F.when(c, x)
    technical, deployment = F.col("kind") == "technical", F.col("kind") == "deployment"
    bits = F.col("bits").cast("string")
    fixed = [
        here(F.lit("all"), plain),
        some(F.array_contains("categories", F.col("category")), here(F.concat(F.lit("category "), "category"), plain)),
        some(F.col("balanced") & F.col("relevant"), here(F.lit("document"), plain)),
        some(deployment & (F.col("bits") > 0), here(F.concat(F.lit("slots "), bits), plain)),
        some(technical & F.col("relevant") & (F.col("bits") > 0), here(F.concat(F.lit("slots "), bits), _key(-F.col("answer_score"), -F.col("final_score")))),
        some(technical & F.col("normalized") & (F.col("role") == REPOSITORY), here(F.lit("normalized"), role_key())),
        some(technical & F.col("role_allowed") & F.array_contains("roles", F.col("role")), here(F.concat(F.lit("role "), "role"), role_key())),
    ]
    marks = F.transform(F.when(deployment, F.col("markers")).otherwise(F.array().cast("array<int>")), lambda m: here(F.concat(F.lit("marker "), m.cast("string")), marker_key(m)))
    listed = F.array_compact(F.concat(F.array(*fixed), marks))
    out = rows.select("task_id", "semantic_key", "identity", "paragraph", "document", "position", F.explode(listed).alias("in")).select("*", "in.facet", "in.key").drop("in")
    return out.withColumn("place", F.when(F.col("facet") == "document", F.col("document")).otherwise(F.col("paragraph"))).drop("paragraph", "document")


def contenders(rows: DataFrame, limit: int) -> DataFrame:
    """(task_id, position) of the candidates that the ladder may choose."""
    enough = max(64, 4 * limit * limit)
    sizes = rows.groupBy("task_id").agg(F.count("*").alias("n"))
    small = rows.join(sizes.where(F.col("n") <= enough).select("task_id"), "task_id", "left_semi").select("task_id", "position")
    large = rows.join(sizes.where(F.col("n") > enough).select("task_id"), "task_id", "left_semi")
    # Most lists of a large task are varied: 2 * limit - 1 of their first rows have semantic keys and places of their own, and choices bar fewer. Nothing after them counts.
    at = F.row_number().over(Window.partitionBy("task_id", "facet").orderBy("key"))
    heads = _written(facets(large).withColumn("_n", at).where(F.col("_n") <= enough).drop("_n"), "diversify-heads")
    one = heads.groupBy("task_id", "facet", "place").agg(F.min_by("semantic_key", "key").alias("semantic_key"))
    apart = one.groupBy("task_id", "facet").agg(F.count_distinct("semantic_key").alias("apart"))
    told = heads.groupBy("task_id", "facet").agg(F.count("*").alias("n")).join(apart, ["task_id", "facet"])
    told = _written(told.withColumn("done", (F.col("n") < enough) | (F.col("apart") >= 2 * limit - 1)), "diversify-told")
    easy = heads.join(told.where("done").select("task_id", "facet"), ["task_id", "facet"], "left_semi").select("task_id", "position")
    hard = facets(large).join(told.where("not done").select("task_id", "facet"), ["task_id", "facet"], "left_semi")
    return small.unionByName(easy).unionByName(_few(hard, limit)).distinct()


def _few(listed: DataFrame, limit: int) -> DataFrame:
    """(task_id, position) of the rows of lists that may be chosen, however alike the lists' first rows are."""
    facet, cell = ("task_id", "facet"), ("semantic_key", "identity", "place")

    def first(df: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*facet, *by).orderBy("key"))
        return df.withColumn("_n", at).where(F.col("_n") <= most).drop("_n")

    def best(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return df.groupBy(*facet, *by).agg(F.min("key").alias("key"))

    listed = _written(first(listed, cell, limit), "diversify-listed")
    cells = best(listed, cell)
    # While nothing of a semantic key is chosen, only the first row of each of its places can be; then only the identity that was.
    free = first(first(cells, ("semantic_key", "place"), 1), ("semantic_key",), limit)
    held = free.select("task_id", "semantic_key", "identity").distinct()
    later = first(cells.join(held, ["task_id", "semantic_key", "identity"], "left_semi"), ("semantic_key", "identity"), limit)
    cells = best(free.unionByName(later), cell)
    by_place = first(best(cells, ("place", "semantic_key")), ("place",), limit).drop("key")
    cells = cells.join(by_place, [*facet, "place", "semantic_key"], "left_semi")
    keys = first(best(cells, ("semantic_key",)), (), limit * limit + limit).drop("key")
    cells = cells.join(keys, [*facet, "semantic_key"], "left_semi")
    kept = listed.join(cells.drop("key"), [*facet, *cell], "left_semi").select("task_id", "position")
    # These lists are not read past a row that can't be added, so their first rows count whatever bars them.
    strict = first(listed.where("facet like 'slots %' or facet = 'normalized'"), (), limit + 1).select("task_id", "position")
    return kept.unionByName(strict)


class _State:
    """What a task has chosen, and what that bars."""

    def __init__(self, limit: int):
        self.limit, self.chosen, self.keys, self.identity, self.paragraphs, self.near = limit, [], set(), {}, set(), 0

    def add(self, row: dict, apart: bool) -> bool:
        if len(self.chosen) >= self.limit or row["position"] in self.keys:
            return False
        if self.identity.get(row["semantic_key"], row["identity"]) != row["identity"]:
            self.near += 1
            return False
        if apart and row["paragraph"] in self.paragraphs:
            return False
        self.chosen.append(row)
        self.keys.add(row["position"])
        self.identity.setdefault(row["semantic_key"], row["identity"])
        self.paragraphs.add(row["paragraph"])
        return True


def ladder(rows: list[dict], terms: dict, limit: int) -> tuple[list[dict], int, list[tuple]]:
    """The choice in order, the near duplicates met in steps that look at a fixed number of rows, and for all other steps how far they read:
    (facet, open slots, key of the last row read or None, number chosen before, number chosen after)."""
    rows = sorted(rows, key=lambda r: r["position"])
    state, log = _State(limit), []
    order = list(terms["slots"] if terms["slots"] is not None else ())
    roles, categories = ([] if terms[c] is None else list(terms[c]) for c in ("roles", "categories"))
    full = (1 << len(order)) - 1

    def new_slots(row: dict, open_: int) -> tuple[float, float]:
        new = row["bits"] & open_
        return -float(new.bit_count()), float((new & -new).bit_length() - 1)

    def first(found: list[tuple[tuple, dict]], facet: str, open_: int = 0) -> dict | None:
        """The first that can be added, in the order of its keys."""
        before, counted = len(state.chosen), state.near
        if before >= limit:
            return None
        last = None
        for key, row in sorted(found, key=lambda x: x[0]):
            if state.add(row, False):
                last = (key, row)
                break
        state.near = counted  # counted over all candidates, from the log
        log.append((facet, open_, last and last[0], before, len(state.chosen)))
        return last and last[1]

    if terms["kind"] == "deployment":
        covered = 0
        while len(state.chosen) < limit and full & ~covered:
            open_ = full & ~covered
            row = first([((*new_slots(r, open_), 0.0, 0.0, float(r["position"])), r) for r in rows if r["position"] not in state.keys and r["bits"] & open_], "slots", open_)
            if row is None:
                break
            covered |= row["bits"]
        for m in range(terms["n_markers"] or 0):
            if len(state.chosen) >= limit:
                break
            if any(m in r["markers"] for r in state.chosen):
                continue
            key = lambda r, m=m: (float(m not in r["exact_markers"]), float(not r["code"]), -r["source_quality"], -r["final_score"], float(r["position"]))
            first([(key(r), r) for r in rows if r["position"] not in state.keys and m in r["markers"]], f"marker {m}")
    role_key_ = lambda r: (float(not r["relevant"]), -r["answer_score"], -r["final_score"], 0.0, float(r["position"]))
    if terms["kind"] == "technical" and order:
        for row in sorted((r for r in rows if r["normalized"] and r["role"] == REPOSITORY), key=role_key_)[:2]:
            state.add(row, False)
        for role in roles:
            if len(state.chosen) >= limit:
                break
            if not any(r["role"] == role for r in state.chosen):
                first([(role_key_(r), r) for r in rows if r["position"] not in state.keys and r["role"] == role and r["role_allowed"]], f"role {role}")
        covered = 0
        for r in state.chosen:
            covered |= r["bits"]
        while len(state.chosen) < limit and full & ~covered:
            open_ = full & ~covered
            found = [((*new_slots(r, open_), -r["answer_score"], -r["final_score"], r["position"]), r) for r in rows if r["position"] not in state.keys and r["bits"] & open_ and r["relevant"]]
            if not found or not state.add((row := min(found, key=lambda x: x[0])[1]), False):
                break
            covered |= row["bits"]

    def walk(facet: str, apart: bool, documents: set | None = None, one: bool = False, wanted=lambda r: True) -> None:
        """Read all rows in their order: each that can be added is, or only the first one."""
        before, counted, last = len(state.chosen), state.near, None
        if before >= limit:
            return
        for r in rows:
            if not wanted(r) or documents is not None and r["document"] in documents:
                continue
            if state.add(r, apart):
                if documents is not None:
                    documents.add(r["document"])
                if one or len(state.chosen) >= limit:
                    last = (0.0, 0.0, 0.0, 0.0, float(r["position"]))
                    break
        state.near = counted
        log.append((facet, 0, last, before, len(state.chosen)))

    if terms["balanced"]:
        walk("document", True, documents={r["document"] for r in state.chosen}, wanted=lambda r: r["relevant"])
    for c in categories:
        walk(f"category {c}", True, one=True, wanted=lambda r, c=c: r["category"] == c)
    walk("all", True)
    walk("all", False)
    return state.chosen, state.near, log


LOG = "facet string, open long, k0 double, k1 double, k2 double, k3 double, k4 double, before int, after int"


def choose(candidates: DataFrame, tasks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(task_id, position, choice) of the chosen candidates, choice from 1 in the order of choosing; and (task_id, near_duplicates) of each task."""
    rows = _written(_prepared(candidates, tasks), "diversify-rows")
    few = rows.join(contenders(rows, limit), ["task_id", "position"], "left_semi")
    kind = rows.schema["task_id"].dataType.simpleString()
    schema = f"task_id {kind}, position long, choice int, semantic_key binary, identity binary, document binary, met int, log array<struct<{LOG.replace(' ', ':').replace(',:', ',')}>>"
    terms = tasks.select("task_id", F.col("slots").alias("slot_order"))

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        one = found[0]
        own = {"kind": one["kind"], "slots": one["slot_order"], "n_markers": one["n_markers"] or 0, "roles": one["roles"], "categories": one["categories"], "balanced": one["balanced"]}
        for r in found:
            r["markers"], r["exact_markers"] = set(r["markers"]), set(r["exact_markers"])
        chosen, met, log = ladder(found, own, limit)
        said = [dict(zip(("facet", "open", *STOP, "before", "after"), (f, o, *(k or (None,) * 5), b, a), strict=True)) for f, o, k, b, a in log]
        out = [{"task_id": r["task_id"], "position": r["position"], "choice": i + 1, "semantic_key": r["semantic_key"], "identity": r["identity"], "document": r["document"], "met": met, "log": said} for i, r in enumerate(chosen)]
        return pa.Table.from_pylist(out, schema=out_schema)

    chosen = _written(few.join(terms, "task_id").groupBy("task_id").applyInArrow(run, schema), "diversify-chosen")
    return chosen.select("task_id", "position", "choice"), _near_duplicates(rows, chosen, tasks)


def _near_duplicates(rows: DataFrame, chosen: DataFrame, tasks: DataFrame) -> DataFrame:
    """How often the ladder passed over a near duplicate: candidates in conflict with a choice, against the steps that read them."""
    # The first choice of each semantic key decides which identity may go on; of each document, when it is covered. At most `limit` rows a task.
    of = lambda c: Window.partitionBy("task_id", c).orderBy("choice")
    taken = chosen.withColumn("_n", F.row_number().over(of("semantic_key"))).where("_n = 1").select("task_id", "semantic_key", F.col("identity").alias("held"), F.col("choice").alias("at"), F.col("position").alias("at_position"))
    covered = chosen.withColumn("_n", F.row_number().over(of("document"))).where("_n = 1").select("task_id", "document", F.col("choice").alias("covered"), F.col("position").alias("covered_position"))
    # Only semantic keys with several identities can be in conflict.
    several_ = rows.groupBy("task_id", "semantic_key").agg(F.min("identity").alias("a"), F.max("identity").alias("b")).where("a <> b").select("task_id", "semantic_key")
    taken = taken.join(several_, ["task_id", "semantic_key"], "left_semi")
    clash = rows.join(taken, ["task_id", "semantic_key"]).where("identity <> held").join(covered, ["task_id", "document"], "left")
    steps = chosen.where("choice = 1").select("task_id", "met", F.explode("log").alias("step"))
    pairs = clash.join(steps.select("task_id", "step"), "task_id")  # each conflicting candidate with the steps of its task, a few dozen at most
    facet, open_ = F.col("step.facet"), F.col("step.open")
    new = F.col("bits").bitwiseAND(open_)
    lowest = (F.length(F.bin(new.bitwiseAND(-new))) - 1).cast("double")
    slot_key = F.struct((-F.bit_count(new)).cast("double").alias("k0"), lowest.alias("k1"), F.lit(0.0).alias("k2"), F.lit(0.0).alias("k3"), F.col("position").cast("double").alias("k4"))
    word, arg = F.split(facet, " ", 2)[0], F.split(facet, " ", 2)[1]
    marker = F.when(word == "marker", arg.cast("int"))
    key = F.when(word == "slots", slot_key).when(word == "marker", marker_key(marker)).when(word == "role", role_key()).otherwise(_key())
    several = word.isin("all", "document")
    # The choice came before the step, or in the same walk at an earlier row.
    earlier = lambda choice, position: (F.col(choice) <= F.col("step.before")) | several & (F.col(choice) <= F.col("step.after")) & (F.col(position) < F.col("position"))
    inside = (
        F.when(word == "slots", new != 0).when(word == "marker", F.array_contains("markers", marker)).when(word == "role", (F.col("role") == arg) & F.col("role_allowed"))
        .when(word == "category", F.col("category") == arg).when(word == "document", F.col("relevant") & ~F.coalesce(earlier("covered", "covered_position"), F.lit(False))).otherwise(F.lit(True))
    )
    stop = F.struct(*[F.col(f"step.{k}").alias(k) for k in STOP])
    read = F.col("step.k4").isNull() | (key < stop)
    counted = pairs.where(earlier("at", "at_position") & inside & read).groupBy("task_id").agg(F.count("*").alias("n"))
    met = chosen.where("choice = 1").select("task_id", "met")
    both = tasks.select("task_id").distinct().join(met, "task_id", "left").join(counted, "task_id", "left")
    return both.select("task_id", (F.coalesce("met", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("near_duplicates"))
