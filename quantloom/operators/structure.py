"""Expressions as rows of a table: what they are made of, which are alike, and which of them to keep.

Similarity is that of expressions.similarity. Two upper bounds make pairs above a threshold a join:

* The share of the largest common subtree of s nodes is 2 s / (|a| + |b|), and s is at most |b|. Above the
  threshold t, s must exceed t / (2 - t) of |a| and of |b|: an expression is found by its few largest subtrees.
* The nodes that match from the top are those whose whole path from the root matches, so their number is the
  weight of the common elements of two sets of paths. Above t, it exceeds t times the larger size: under one
  order of the elements, rare ones first, the two sets share one of their first elements, those before what
  is left weighs t times the own size or less.

Only pairs that share a key are scored. Expressions that no similarity can tell apart are one class first, so copies
of one expression, however many, meet no other; a key that many classes share is split by Spark, as both
sides are written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.session import dropped, saved, ship

MOST = 0.85
DESCRIBED = "expr string, valid boolean, canonical string, hash string, sl int, pc int, fc int, listed boolean, plain string, dollar string"
CLASS = "expr string, class string, whole string, size int, subtrees array<struct<key:string,size:int>>, paths array<struct<path:string,weight:int>>"


def described(exprs: DataFrame) -> DataFrame:
    """expr and what it is made of, for each distinct expr of the table; canonical, hash and counts are null where it doesn't parse."""
    ship(exprs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["expr"]:
                try:
                    n = X.parse(text)
                    own = (X.validate(text)["valid"], X.serialize(n), X.expr_hash(n), *X.complexity(n).values())
                except ValueError:
                    own = (False, None, None, None, None, None)
                rows.append((text, *own, X.is_listed(text), X.to_plain(text), X.to_dollar(text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DESCRIBED.split(", ")]).astype({c: "Int32" for c in ("sl", "pc", "fc")})

    return exprs.select("expr").where("expr IS NOT NULL").distinct().mapInPandas(run, DESCRIBED)


def paths(n: X.Node) -> list[tuple[str, int]]:
    """(path, weight) of the elements of a canonical tree: two trees match from the top in the weight of those they share."""
    out = []

    def walk(x: X.Node, above: str) -> None:
        if x.op == X.FIELD:
            out.append((f"{above}/{x.op}{x.args[0]}", 1))
            return
        here = f"{above}/{x.op}:{len(x.kids)}"
        out.append((here, 1))
        if x.params:
            out.append((f"{here}={','.join(map(repr, x.params))}", len(x.params)))
        for k, kid in enumerate(x.kids):
            walk(kid, f"{here}.{k}")

    walk(n, "")
    return out


def _classed(most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["expr"]:
                try:
                    n = X.parse(text)
                except ValueError:
                    continue
                whole, sizes = X.serialize(n), X.subtree_sizes(n)
                held = [{"key": k, "size": s} for k, s in sizes.items() if s > most / (2 - most) * n.size]
                name = hashlib.sha256("|".join([whole, str(n.size), *(f"{k}={s}" for k, s in sorted(sizes.items()))]).encode()).hexdigest()
                rows.append((text, name, whole, n.size, held, [{"path": p, "weight": w} for p, w in paths(X.canonical(n))]))
            yield pd.DataFrame(rows, columns=["expr", "class", "whole", "size", "subtrees", "paths"])

    return run


def classes(exprs: DataFrame, most: float = MOST) -> DataFrame:
    """expr, class, whole (canonical form), size, subtrees (the largest ones), paths of each distinct expr that parses; written."""
    ship(exprs.sparkSession)
    return saved(exprs.select("expr").where("expr IS NOT NULL").distinct().mapInPandas(_classed(most), CLASS), "classes")


def _keys(of: DataFrame, most: float) -> DataFrame:
    """class, size, key, same of one expression a class; any pair above the threshold shares a key, and is near in size or has one canonical form (same)."""
    one = saved(of.groupBy("class").agg(F.first("whole").alias("whole"), F.first("size").alias("size"), F.first("subtrees").alias("subtrees"), F.first("paths").alias("paths")), "one")
    by_form = one.select("class", "size", F.xxhash64(F.lit("form"), "whole").alias("key"), F.lit(True).alias("same"))
    by_tree = one.select("class", "size", F.explode("subtrees.key").alias("key")).select("class", "size", F.xxhash64(F.lit("tree"), "key").alias("key"), F.lit(False).alias("same"))
    path = one.select("class", "size", F.explode("paths").alias("p")).select("class", "size", F.xxhash64(F.lit("path"), "p.path").alias("key"), F.col("p.weight").alias("weight"))
    path = saved(path, "paths")
    often = path.groupBy("key").agg(F.count("*").alias("often"))
    rare_first = Window.partitionBy("class").orderBy("often", "key")
    left = F.sum("weight").over(rare_first.rowsBetween(0, Window.unboundedFollowing))
    # An element is needed as long as it and those behind it could weigh enough without any before.
    by_path = path.join(often, "key").withColumn("left", left).where(F.col("left") > F.lit(most) * F.col("size")).select("class", "size", "key", F.lit(False).alias("same"))
    keys = saved(by_form.unionByName(by_tree).unionByName(by_path).distinct(), "keys")
    dropped(path)
    return keys


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trees: dict[str, X.Node] = {}

    def tree(text: str) -> X.Node:
        if text not in trees:
            if len(trees) > 1 << 16:
                trees.clear()
            trees[text] = X.parse(text)
        return trees[text]

    for b in batches:
        yield b.assign(similarity=[X.similarity(tree(x), tree(y)) for x, y in zip(b["expr_a"], b["expr_b"], strict=True)])[["a", "b", "similarity"]]


def alike(of: DataFrame, most: float = MOST) -> DataFrame:
    """a, b (classes, a < b), similarity of all pairs of different classes above the threshold."""
    keys = _keys(of, most)
    other = keys.select(F.col("class").alias("b"), F.col("size").alias("size_b"), "key", "same")
    near = F.least("size", "size_b") > F.lit(most / (2 - most)) * F.greatest("size", "size_b")
    pairs = saved(keys.withColumnRenamed("class", "a").join(other, ["key", "same"]).where((F.col("a") < F.col("b")) & (F.col("same") | near)).select("a", "b").distinct(), "pairs")
    text = of.groupBy("class").agg(F.min("expr").alias("expr"))
    rows = pairs.join(text.select(F.col("class").alias("a"), F.col("expr").alias("expr_a")), "a").join(text.select(F.col("class").alias("b"), F.col("expr").alias("expr_b")), "b")
    scored = rows.mapInPandas(_scored, "a string, b string, similarity double").where(F.col("similarity") > most)
    return saved(scored, "alike")


def first_ones(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node of those kept when the nodes (node, place) are gone through by place, each kept unless linked to a kept one.

    Done in rounds: an undecided node is kept once no undecided or kept neighbour is before it, and drops out
    once a kept one is. Each round decides all nodes at the head of a chain of links, in any number of places at once.
    """
    places = nodes.select("node", "place")
    link = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    link = link.join(places.select(F.col("node").alias("x"), F.col("place").alias("px")), "x").join(places.select(F.col("node").alias("y"), F.col("place").alias("py")), "y")
    # x is before y.
    open_links = saved(link.where("px < py").select("x", "y"), "links")
    gone = None
    while True:
        waiting = open_links.select(F.col("y").alias("node")).distinct()
        heads = open_links.select(F.col("x").alias("node")).distinct().join(waiting, "node", "left_anti")
        out = saved(open_links.join(heads.withColumnRenamed("node", "x"), "x", "left_semi").select(F.col("y").alias("node")).distinct(), "gone")
        if out.isEmpty():
            break
        gone = out if gone is None else gone.unionByName(out)
        left = open_links.join(out.withColumnRenamed("node", "x"), "x", "left_anti").join(out.withColumnRenamed("node", "y"), "y", "left_anti")
        left = saved(left.select("x", "y"), "links")
        dropped(open_links)
        open_links = left
    return places.select("node") if gone is None else places.select("node").join(gone, "node", "left_anti")


def structural_dedup(candidates: DataFrame, corpus: DataFrame, most: float = MOST) -> DataFrame:
    """The rows of candidates (place, expr and more) that are kept when they are gone through by place.

    A row is dropped if it is more similar than `most` to an expression of the corpus (expr) or to a row kept before;
    a row without an expression, or with one that doesn't parse, is kept and hides no other. Places are distinct.
    """
    known = corpus.select("expr")
    of = classes(candidates.select("expr").unionByName(known), most)
    pairs = alike(of, most)
    first = candidates.where("expr IS NOT NULL").groupBy("expr").agg(F.min("place").alias("place"))
    placed = first.join(of.select("expr", "class"), "expr").groupBy("class").agg(F.min("place").alias("place"))
    old = of.join(known.distinct(), "expr", "left_semi").select("class").distinct()
    like_old = pairs.join(old.withColumnRenamed("class", "a"), "a", "left_semi").select(F.col("b").alias("class")).unionByName(pairs.join(old.withColumnRenamed("class", "b"), "b", "left_semi").select(F.col("a").alias("class")))
    new = saved(placed.join(old.unionByName(like_old).distinct(), "class", "left_anti"), "new")
    kept = first_ones(new.withColumnRenamed("class", "node"), pairs).join(new.select(F.col("class").alias("node"), "place"), "node").select("place")
    unparsed = candidates.join(of.select("expr"), "expr", "left_anti").select("place")
    return candidates.join(kept.unionByName(unparsed), "place", "left_semi")


def most_similar(exprs: DataFrame, corpus: DataFrame) -> DataFrame:
    """expr, similarity: of each distinct expr that parses, the largest similarity to an expression of the corpus that parses, 0 without one.

    The corpus is a list of known factors: its distinct expressions go to every task, MOST_KNOWN at most.
    """
    ship(exprs.sparkSession)
    known = [r["expr"] for r in corpus.select("expr").where("expr IS NOT NULL").distinct().limit(MOST_KNOWN + 1).collect()]
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known expressions; use alike() for pairs above a threshold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["expr"]:
                try:
                    rows.append((text, X.most_similar(text, known)))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["expr", "similarity"])

    return exprs.select("expr").where("expr IS NOT NULL").distinct().mapInPandas(run, "expr string, similarity double")


#: Known expressions that go to every task.
MOST_KNOWN = 1000
