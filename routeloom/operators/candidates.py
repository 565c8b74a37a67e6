"""Candidate edges by a plan: the union of neighbour graphs, tours and trees that it asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize
from ..sources.generate import random_edges_of, random_tour_of
from .construct import boruvka_tour, greedy_tour, minimum_spanning_tree, space_filling_tour
from .edges import oriented
from .neighbors import knn_graph, quadrant_knn
from .tours import tour_edges

#: Commands of a plan, as they stand in its text; those of solvers and sequential searches aren't supported.
COMMANDS = ("RANDOM", "NEAREST", "QUADNEAREST", "GREEDY_TOUR", "BORUVKA_TOUR", "SPACE_FILLING_TOUR", "RANDOM_TOUR", "TREE")


def parse_plan(text: str) -> dict[str, int]:
    """command -> its number (1 if it has none), of lines ``EDGEGEN command [number]``; empty lines and those of # are left out."""
    plan: dict[str, int] = {}
    for line in text.splitlines():
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0] != "EDGEGEN" or len(words) < 2 or words[1] not in COMMANDS or len(words) > 3:
            raise ValueError(f"a plan's line isn't supported: {line.strip()!r}")
        plan[words[1]] = int(words[2]) if len(words) == 3 else 1
    return plan


def candidate_edges(nodes: DataFrame, plan: dict[str, int], norm: str = "EUC_2D", seed: int = 0) -> DataFrame:
    """i, j, len of the union of all that the plan asks for, each edge once. ``nodes``: id (0 to n - 1), x, y."""
    if unknown := sorted(set(plan) - set(COMMANDS)):
        raise ValueError(f"not supported in a plan: {', '.join(unknown)}")
    quadrants = lambda k: quadrant_knn(nodes, k, norm).select(F.col("id").alias("i"), F.col("nbr").alias("j"), "len")
    near = materialize(oriented(quadrants(2)).distinct(), "candidates") if {"GREEDY_TOUR", "TREE"} & set(plan) else None
    along = lambda tour: tour_edges(tour, nodes, norm).select("i", "j", "len")
    made = {
        "RANDOM": lambda k: random_edges_of(nodes, k, norm, seed),
        "NEAREST": lambda k: knn_graph(nodes, k, norm),
        "QUADNEAREST": quadrants,
        "GREEDY_TOUR": lambda _: along(greedy_tour(nodes, near, norm)),
        "BORUVKA_TOUR": lambda _: along(boruvka_tour(nodes, norm)),
        "SPACE_FILLING_TOUR": lambda _: along(space_filling_tour(nodes)),
        "RANDOM_TOUR": lambda k: reduce(DataFrame.unionByName, [along(random_tour_of(nodes, norm, seed + n)[0]) for n in range(k)]),
        "TREE": lambda _: minimum_spanning_tree(near),
    }
    parts = [made[command](k) for command, k in plan.items() if k > 0]
    if not parts:
        raise ValueError("the plan is empty")
    return oriented(reduce(DataFrame.unionByName, [p.select("i", "j", F.col("len").cast("long").alias("len")) for p in parts])).distinct()
