"""Which texts contain which patterns, by Aho-Corasick automata: each text is read once whatever the number of patterns, and nothing is made per character.

The side with fewer bytes goes to the tasks in blocks of `block_bytes` (one block unless it is larger), chosen by the texts' hash; the other side stays
where it lies and is streamed. If patterns go, a task builds one automaton a block and runs its texts through it; if texts go, a task builds automata from
its own patterns, some megabytes at a time, and runs the block's texts through each. Either way pairs are found where the larger side lies, without a shuffle.

`token_shares` is retrieval by the same means: which part of a query's tokens a text contains. Tokens of the queries, a stated and size-checked set sent in blocks, form one automaton with
the queries of each token beside it; a text is read once, its hits are summed by query in the task, and only pairs above the threshold leave it.

Defined cases: an empty pattern is in no text; repeated patterns and texts count once; nulls are ignored; an empty side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
#: Bytes of patterns in one automaton where the patterns are the streamed side.
BUILT_BYTES = 4 << 20
#: Characters of tokens that are searched for one by one, if there are no more of them than this.
SHORT, MOST_SHORT = 2, 100


def automaton(patterns: list[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for p in patterns:
        built.add_word(p, p)
    built.make_automaton()
    return built


def found(built, text: str) -> set[str]:
    return {p for _, p in built.iter(text)}


def _size(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("x"))).first()[0] or 0


def _emit(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], names=["pattern", "text"])


def contained(patterns: DataFrame, texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(pattern, text): all pairs where the text contains the pattern. Each side is a table of one string column, best written before."""
    spark = patterns.sparkSession
    patterns = patterns.toDF("x").where("x <> ''").distinct()
    texts = texts.toDF("x").where("x is not null").distinct()
    sizes = _size(patterns), _size(texts)
    few, many, patterns_go = (patterns, texts, True) if sizes[0] <= sizes[1] else (texts, patterns, False)
    blocks = max(1, -(-min(sizes) // block_bytes))
    out = None
    for block in range(blocks):
        sent = spark.sparkContext.broadcast([r["x"] for r in few.where(F.pmod(F.xxhash64("x"), F.lit(blocks)) == block).collect()])  # block_bytes or so, at most

        def by_patterns(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            built = automaton(sent.value)
            for batch in batches:
                if len(built):
                    yield _emit([(p, t) for t in batch.column(0).to_pylist() for p in found(built, t)])

        def by_texts(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def run(patterns: list[str]) -> Iterator[pa.RecordBatch]:
                built = automaton(patterns)
                pairs: list[tuple[str, str]] = []
                for t in sent.value:
                    pairs += [(p, t) for p in found(built, t)]
                    if len(pairs) > 10_000:
                        yield _emit(pairs)
                        pairs = []
                yield _emit(pairs)

            own, size = [], 0
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    own.append(p)
                    size += len(p)
                    if size > BUILT_BYTES:
                        yield from run(own)
                        own, size = [], 0
            if own:
                yield from run(own)

        pairs = many.mapInArrow(by_patterns if patterns_go else by_texts, "pattern string, text string")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def token_shares(queries: DataFrame, texts: DataFrame, id_cols: list[str], text_col: str, least: float, block_bytes: int = BLOCK_BYTES, phrase_col: str | None = None) -> DataFrame:
    """(id_cols, query, share): texts that contain at least this share of a query's tokens, as substrings. queries: query (long), tokens (distinct strings); those without tokens match nothing.
    With phrase_col, a string of the queries made of their tokens, also whole: whether the text contains it."""
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    spark = queries.sparkSession
    queries = queries.select(F.col("query").cast("long").alias("query"), "tokens", (F.col(phrase_col) if phrase_col else F.lit(None).cast("string")).alias("phrase")).where("size(tokens) > 0")
    size = queries.agg(F.sum(F.aggregate("tokens", F.coalesce(F.octet_length("phrase"), F.lit(0)), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    own = [texts.schema[c] for c in id_cols]
    schema = StructType([*own, StructField("query", LongType()), StructField("share", DoubleType()), *([StructField("whole", BooleanType())] if phrase_col else [])])
    source, out = texts.where(F.col(text_col).isNotNull()).select(*id_cols, text_col), None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()  # block_bytes or so, at most
        sent = spark.sparkContext.broadcast([(r["query"], list(r["tokens"]), r["phrase"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import numpy as np

            of: dict[str, list[int]] = {}
            for i, (_, tokens, _) in enumerate(sent.value):
                for t in tokens:
                    of.setdefault(t, []).append(i)
            short = [t for t in of if len(t) <= SHORT]  # an automaton stops at every place of these, a search at the first
            short = short if len(short) <= MOST_SHORT else []
            built, ids, sizes = automaton(list(set(of) - set(short))), np.array([q for q, *_ in sent.value], np.int64), np.array([len(t) for _, t, _ in sent.value], np.int64)
            lists = {t: np.array(v) for t, v in of.items()}
            for batch in batches:
                at, query, share, whole = [], [], [], []
                for i, text in enumerate(batch.column(len(own)).to_pylist() if of else ()):
                    hits = [lists[t] for t in (found(built, text) if len(built) else ())] + [lists[t] for t in short if t in text]
                    if hits:
                        shares = np.bincount(np.concatenate(hits), minlength=len(ids)) / sizes
                        some = np.flatnonzero(shares >= least)
                        at += [i] * len(some)
                        query.append(ids[some])
                        share.append(shares[some])
                        if phrase_col:
                            whole += [bool(shares[j] >= 1 and sent.value[j][2] in text) for j in some.tolist()]
                take = pa.array(at, pa.int64())
                columns = [c.take(take) for c in batch.columns[: len(own)]]
                flat = [pa.array(np.concatenate(x) if x else [], kind) for x, kind in ((query, pa.int64()), (share, pa.float64()))]
                flat += [pa.array(whole, pa.bool_())] if phrase_col else []
                yield pa.RecordBatch.from_arrays([*columns, *flat], names=[f.name for f in schema.fields])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
