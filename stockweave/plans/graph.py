"""Synonym rules as a token graph.

The nodes of a query's graph lie between its terms.  A term is an edge from the node
before it to the one behind it; a synonym is an edge over the run of terms that its
rule's head matches, so overlapping rules of several terms are edges that cross.  A
path from the first to the last node is a variant of the query, and a document
matches if it matches one.  A deleted term is an edge that asks for nothing.

For one query the graph is compiled to Columns: what each run's alternatives score is
computed once, and each variant is arithmetic on those numbers.  For a table of
queries, edges and deletions are found by joining the queries' runs with the rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from .rules import Instruction

Rules = dict[tuple[str, ...], list[Instruction]]


@dataclass(frozen=True)
class Alternative:
    """Words that stand for a run of terms; several words are a phrase."""

    words: tuple[str, ...]
    weight: float = 1.0

    def label(self) -> str:
        text = f'"{" ".join(self.words)}"' if len(self.words) > 1 else self.words[0]
        return text if self.weight == 1 else f"{text}^{self.weight:g}"


@dataclass
class Graph:
    terms: list[str]
    #: Alternatives of each run ``(begin, end)``, the term itself first; none for a deleted term.
    spans: dict[tuple[int, int], list[Alternative]] = field(default_factory=dict)

    def paths(self) -> Iterator[list[tuple[int, int]]]:
        """The variants, those of more and shorter runs first."""
        ends: dict[int, list[int]] = {}
        for a, b in sorted(self.spans):
            ends.setdefault(a, []).append(b)

        def onward(at: int) -> Iterator[list[tuple[int, int]]]:
            if at == len(self.terms):
                yield []
            for b in ends.get(at, ()):
                for rest in onward(b):
                    yield [(at, b), *rest]

        return onward(0)

    def label(self) -> str:
        def one(span: tuple[int, int]) -> str:
            some = [a.label() for a in self.spans[span]]
            return f"({' OR '.join(some)})" if len(some) > 1 else some[0]

        variants = [" ".join(one(s) for s in path if self.spans[s]) for path in self.paths()]
        return variants[0] if len(variants) == 1 else " OR ".join(f"({v})" for v in variants)


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.lower().strip("() ").split())


def build(q: str, rules: Rules) -> Graph:
    """The graph of a query; if rules delete all of it, none does."""
    terms = q.lower().split()
    graph, gone = Graph(terms), set()
    for i, t in enumerate(terms):
        graph.spans[i, i + 1] = [Alternative((t,))]
    for head, instructions in rules.items():
        for i in range(len(terms) - len(head) + 1):
            if tuple(terms[i : i + len(head)]) != head:
                continue
            for x in instructions:
                if x.kind == "SYNONYM" and _words(x.text):
                    graph.spans.setdefault((i, i + len(head)), []).append(Alternative(_words(x.text), x.weight))
                elif x.kind == "DELETE":
                    gone |= set(range(i, i + len(head)))
    if len(gone) < len(terms):
        for i in gone:
            graph.spans[i, i + 1] = []
    return graph


def search(docs: DataFrame, fields: dict[str, Column], graph: Graph, weights: dict[str, float] | None = None, spec: str = "100%") -> DataFrame:
    """Documents that match enough runs of a variant, with the ``score`` of their best one.

    An alternative scores its weight times that of its best field, a run as its best
    alternative, a variant the sum of its runs; so a document doesn't count twice that
    has a term and its synonym.  ``spec`` is what :func:`matching.min_should_match`
    reads, for the number of runs that a variant asks for."""
    weights = weights or {}
    asked = [s for s, some in graph.spans.items() if some]
    at = {s: i for i, s in enumerate(asked)}

    def run(span: tuple[int, int]) -> Column:
        found = [F.when(M.phrase(c, list(a.words)) if len(a.words) > 1 else M.has(c, a.words[0]), F.lit(a.weight * weights.get(n, 1.0))).otherwise(0.0) for a in graph.spans[span] for n, c in fields.items()]
        return F.greatest(*found, F.lit(0.0))

    runs, score = "__runs", F.lit(None).cast("double")
    for path in graph.paths():
        own = [F.get(F.col(runs), at[s]) for s in path if s in at]
        if own:
            matched = reduce(Column.__add__, [(c > 0).cast("int") for c in own])
            enough = matched >= M.min_should_match(spec, len(own))
            score = F.greatest(score, F.when(enough, reduce(Column.__add__, own)))
    scored = docs.withColumn(runs, F.array(*[run(s) for s in asked])).withColumn("score", score)
    return scored.drop(runs).filter("score IS NOT NULL")


# --- tables of queries


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``head, kind, weight, text``: one row an instruction."""
    rows = [(" ".join(head), x.kind, float(x.weight), " ".join(_words(x.text))) for head, some in rules.items() for x in some]
    return spark.createDataFrame(rows, "head string, kind string, weight double, text string")


def runs(queries: DataFrame, longest: int, key: str = "query", terms: str = "terms") -> DataFrame:
    """``query, begin, end, head``: all runs of up to ``longest`` terms."""
    n, none = F.size(terms), F.array().cast("array<struct<begin:int,end:int,head:string>>")

    def of_length(k: int) -> Column:
        run = lambda i: F.struct(i.alias("begin"), (i + k).alias("end"), F.array_join(F.slice(F.col(terms), i + 1, F.lit(k)), " ").alias("head"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).otherwise(none)

    listed = F.concat(*map(of_length, range(1, longest + 1)))
    return queries.select(key, F.inline(listed))


def edges(queries: DataFrame, rules: Rules, key: str = "query", terms: str = "terms") -> DataFrame:
    """``query, begin, end, text, weight``: the graphs of all queries, terms and synonyms.

    Rules are a configuration's, so they are broadcast; queries aren't shuffled."""
    spark = queries.sparkSession
    longest = max((len(h) for h in rules), default=1)
    synonyms = F.broadcast(rule_table(spark, rules).filter("kind = 'SYNONYM' AND text <> ''"))
    own = queries.select(key, F.posexplode(terms).alias("begin", "text")).select(key, "begin", (F.col("begin") + 1).alias("end"), "text", F.lit(1.0).alias("weight"))
    return own.unionByName(runs(queries, longest, key, terms).join(synonyms, "head").select(key, "begin", "end", "text", "weight"))


def without_deleted(queries: DataFrame, rules: Rules, terms: str = "terms") -> DataFrame:
    """The queries without terms that rules delete; one that would lose all of them keeps them."""
    heads = [list(h) for h, some in rules.items() if any(x.kind == "DELETE" for x in some)]
    if not heads:
        return queries
    t = F.col(terms)

    def covered(i: Column) -> Column:
        hit = [F.slice(t, F.greatest(i - j + 1, F.lit(1)), F.lit(len(h))) == F.array(*map(F.lit, h)) for h in heads for j in range(len(h))]
        begins = [i >= j for h in heads for j in range(len(h))]
        return reduce(Column.__or__, [a & b for a, b in zip(begins, hit)])

    kept = F.filter(t, lambda _, i: ~covered(i))
    return queries.withColumn(terms, F.when(F.size(kept) > 0, kept).otherwise(t))
