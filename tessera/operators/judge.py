"""Judging of answers by a callable, a model or a stub: scores, swapped pairs, consistency.

The callable takes a prompt and returns a dict. It is called on executors, row by row inside Arrow batches; a reply that can't be
used counts as the lowest score, and an empty answer is not sent at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluate

Judge = Callable[[str], dict]


def whole(value, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return low


def score(runs: DataFrame, judge: Judge) -> DataFrame:
    """(run_id, grounding, faithfulness, unsupported) of runs (run_id, question, answer, cited, existence_rate)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if not (r.answer or "").strip():
                    out.append((r.run_id, 0, 0, []))
                    continue
                got = judge(f"Question: {r.question}\n\nAnswer: {r.answer}\n\nCited code:\n{r.cited or '(none)'}") or {}
                claims = [str(c) for c in got.get("unsupported") or []]
                if r.existence_rate is None or pd.isna(r.existence_rate):
                    claims = ["no citation", *claims]
                out.append((r.run_id, whole(got.get("grounding"), 0, 5), whole(got.get("faithfulness"), 0, 5), claims))
            yield pd.DataFrame(out, columns=["run_id", "grounding", "faithfulness", "unsupported"]).astype({"unsupported": object})

    kind = runs.schema["run_id"].dataType.simpleString()
    return runs.select("run_id", "question", "answer", "cited", "existence_rate").mapInPandas(run, f"run_id {kind}, grounding int, faithfulness int, unsupported array<string>")


def pairs(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Every run of one tool against every run of the other, within a task; a task has as many runs as seeds."""
    side = lambda tool, p: runs.where(F.col("tool") == tool).select("task", "question", F.col("answer").alias(p))
    return side(first, "a").join(side(second, "b").drop("question"), "task").withColumns({"tool_a": F.lit(first), "tool_b": F.lit(second)})


def compare(paired: DataFrame, judge: Judge) -> DataFrame:
    """(task, winner, confidence) of pairs, each judged twice with the order swapped; an empty answer loses to one that isn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                a, c = bool((r.a or "").strip()), bool((r.b or "").strip())
                if not (a and c):
                    w = r.tool_a if a else r.tool_b if c else "Tie"
                    out.append((r.task, w, "high", w, "high"))
                    continue
                ask = lambda x, y: judge(f"Question: {r.question}\n\nCandidate 1:\n{x}\n\nCandidate 2:\n{y}") or {}  # noqa: B023, E731
                one, two = ask(r.a, r.b), ask(r.b, r.a)
                named = lambda g, x, y: {"Candidate 1": x, "Candidate 2": y}.get(g.get("winner"), "Tie")
                out.append((r.task, named(one, r.tool_a, r.tool_b), one.get("confidence", "low"), named(two, r.tool_b, r.tool_a), two.get("confidence", "low")))
            yield pd.DataFrame(out, columns=["task", "ab", "ab_c", "ba", "ba_c"])

    kind = paired.schema["task"].dataType.simpleString()
    both = paired.mapInPandas(run, f"task {kind}, ab string, ab_c string, ba string, ba_c string")
    winner, confidence = evaluate.verdict(F.col("ab"), F.col("ab_c"), F.col("ba"), F.col("ba_c"))
    return both.select("task", winner.alias("winner"), confidence.alias("confidence"))


def judge_all(runs: DataFrame, files: DataFrame, judge: Judge, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """(scores, verdicts by task) of runs (run_id, task, tool, question, answer)."""
    cites = evaluate.existing(evaluate.cited(runs), files)
    rates = evaluate.existence_rate(cites).select("run_id", F.col("rate").alias("existence_rate"))
    text = cites.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("citation")), "\n").alias("cited"))
    full = runs.join(rates, "run_id", "left").join(text, "run_id", "left")
    return score(full, judge), evaluate.majority(compare(pairs(runs, first, second), judge))


