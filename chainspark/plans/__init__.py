"""Registered queries over the driver tables, each with its SQL twin where one exists."""

import importlib

AREAS = ("chain_queries", "estimate_queries", "relation_queries", "inference_queries", "standard_queries",
         "shot_queries", "team_queries", "source_queries")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"chainspark.plans.{area}")
