"""Stack samples as folded lines with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simple_frame(frame: Column, last_segment: bool = False) -> Column:
    name = F.element_at(F.split(frame, "::"), -1) if last_segment else frame
    return F.split_part(name, F.lit("<"), F.lit(1))


def folded(samples: DataFrame, frames: str = "frames", most: int = 20, reverse: bool = True, last_segment: bool = False) -> DataFrame:
    """stack (frames joined by ;) and samples; empty stacks are dropped."""
    kept = F.filter(F.transform(F.slice(frames, 1, most), lambda f: simple_frame(f, last_segment)), lambda f: f != "")
    stack = F.concat_ws(";", F.reverse(kept) if reverse else kept)
    return samples.select(stack.alias("stack")).where("stack <> ''").groupBy("stack").agg(F.count("*").alias("samples"))
