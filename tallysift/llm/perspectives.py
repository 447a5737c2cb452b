"""Multi-party perspective rotation: every dialogue once per participant, with that speaker as the assistant.

For each participant (every speaker but ``system``) a dialogue is rendered with the participant's turns as the
assistant's and all others' as those of users with their names; system turns stay system turns. The mask marks the
characters a model is to learn: each assistant turn's content and end mark. Where a text or name has the start of a
mark in it, a backslash is put inside, so that no turn can pass for another speaker's.

A dialogue is rendered in chunks of ``chunk_turns`` turn numbers, each a sample by itself, so a dialogue of any length
is spread over tasks: turns are grouped by (conversation, chunk), and chunks meet the participants in a join. Turns
that share a number follow each other by speaker and text. A chunk with more than ``chunk_rows`` turns is cut into parts
of so many turns that follow each other in that order, so the parts' texts one behind the other are the chunk's; without
``chunk_rows`` chunks stay whole. Null texts are empty turns, null speakers are called ``unknown``, turns without a number form a chunk
of their own, null conversations are one conversation, repeated rows are repeated turns. A dialogue of system turns only
has no participant and no rendering.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.llm.common import small_side, stored

END = "<|end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"


def safe(text: str) -> str:
    return text.replace("<|", "<\\|")


def name_of(speaker: str) -> str:
    """A name as it stands inside a mark."""
    return safe(speaker).replace("|>", "|\\>").replace("\n", " ")


def render(turns: list[tuple[str, str]], participant: str) -> tuple[str, list[tuple[int, int]]]:
    """(speaker, text) turns as one text and the (start, length) runs of the mask."""
    parts, mask, at = [], [], 0
    for speaker, text in turns:
        if speaker == participant:
            head = "<|assistant|>\n"
        elif speaker == SYSTEM:
            head = "<|system|>\n"
        else:
            head = f"<|user:{name_of(speaker)}|>\n"
        body = safe(text) + END
        if speaker == participant:
            mask.append((at + len(head), len(body)))
        parts += (head, body)
        at += len(head) + len(body)
    return "".join(parts), mask


def in_parts(said: DataFrame, chunk_rows: int) -> DataFrame:
    """Add ``part``: in chunks of more than ``chunk_rows`` turns, the turn's rank over ``chunk_rows``, else 0.

    The turns of large chunks are sorted by ranges, repeated ones too, and a rank is the row in the range plus the rows
    of the chunk in the ranges before."""
    full = stored(said.groupBy("conv", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows)
                  .select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.lit(True).alias("large")), "full")
    if full.isEmpty():
        return said.withColumn("part", F.lit(0).cast("long"))
    dealt = said.join(small_side(full), F.col("conv").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k")), "left")
    order = ["conv", "chunk", "turn", "speaker", "text"]
    rows = stored(dealt.where("large").select(*order, F.monotonically_increasing_id().alias("tie")).orderBy(*order, "tie").select(
        *order, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")), "large")
    tasks = rows.groupBy("conv", "chunk", "task").agg(F.min("row").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("conv", "chunk").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(tasks.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.col("task").alias("t"), (
        F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("offset")), "offsets")
    ranked = rows.join(small_side(offsets), F.col("conv").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))
                       & (F.col("task") == F.col("t")))
    return dealt.where("large IS NULL").select(*order, F.lit(0).cast("long").alias("part")).union(
        ranked.select(*order, F.floor((F.col("row") + F.col("offset")) / chunk_rows).cast("long")))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           chunk_turns: int = 64, chunk_rows: int | None = 4096) -> DataFrame:
    """Per conversation, participant and chunk (``chunk``, ``part`` of it): n_turns, n_own, rendered, mask. Where the
    conversation's column has one of these names, that of the result gets an underscore behind it."""
    said = turns.select(
        F.col(conv).alias("conv"), F.floor(F.col(turn) / chunk_turns).cast("long").alias("chunk"), F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = in_parts(said, chunk_rows) if chunk_rows else said.withColumn("part", F.lit(0).cast("long"))
    chunks = dealt.select("conv", "chunk", "part", F.struct("turn", "speaker", "text").alias("t")).groupBy(
        "conv", "chunk", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("participant")).distinct()
    views = chunks.join(people, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "participant", "chunk", "part", "turns")
    schema = T.StructType([
        T.StructField("conv", turns.schema[conv].dataType), T.StructField("participant", T.StringType()),
        T.StructField("chunk", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n_turns", T.LongType()),
        T.StructField("n_own", T.LongType()), T.StructField("rendered", T.StringType()),
        T.StructField("mask", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks, sizes = [], [], []
            for person, said_ in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                text_, mask = render([(t["speaker"], t["text"]) for t in said_], person)
                texts.append(text_)
                masks.append(mask)
                sizes.append(len(said_))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array([len(m) for m in masks], pa.int64()),
                 pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int64())))], names=schema.names)

    names = [f"{n}_" if n.lower() == conv.lower() else n for n in schema.names[1:]]
    return views.select("conv", "participant", "chunk", "part", "turns").mapInArrow(run, schema).toDF(conv, *names)
