"""Pipelines as node lists, compiled to one lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    name: str
    module: str
    inputs: dict[str, str] = field(default_factory=dict)  # port -> node
    params: dict = field(default_factory=dict)


def read(topology: dict) -> list[Node]:
    """Nodes of a topology {nodes: [{name, module, params, inputs: [{port, from}], outputs: [{to, port}]}]}; edges given on either side are merged. Raises on doubled or unknown names."""
    raw = topology.get("nodes", [])
    names = [n.get("name") for n in raw]
    if None in names or "" in names:
        raise ValueError("a node has no name")
    if len(set(names)) < len(names):
        raise ValueError("two nodes have one name")
    edges: dict[str, dict[str, str]] = {n: {} for n in names}
    for n in raw:
        for i in n.get("inputs", []):
            edges[n["name"]][i["port"]] = i["from"].partition(".")[0]
        for o in n.get("outputs", []):
            if o["to"] not in edges:
                raise ValueError(f"unknown node {o['to']}")
            edges[o["to"]][o["port"]] = n["name"]
    for ports in edges.values():
        for source in ports.values():
            if source not in edges and source != "$":
                raise ValueError(f"unknown node {source}")
    return [Node(n["name"], n["module"], edges[n["name"]], n.get("params", {})) for n in raw]


def write(nodes: list[Node]) -> dict:
    return {"nodes": [{"name": n.name, "module": n.module, "params": n.params, "inputs": [{"port": p, "from": s} for p, s in sorted(n.inputs.items())]} for n in nodes]}


def order(nodes: list[Node]) -> list[Node]:
    """Nodes after all they read from; raises on a cycle."""
    by, out, state = {n.name: n for n in nodes}, [], {}

    def visit(n: Node) -> None:
        if state.get(n.name) == 1:
            raise ValueError(f"cycle at {n.name}")
        if n.name in state:
            return
        state[n.name] = 1
        for s in n.inputs.values():
            if s != "$":
                visit(by[s])
        state[n.name] = 2
        out.append(n)

    for n in nodes:
        visit(n)
    return out


def build(nodes: list[Node], modules: dict[str, Callable[..., DataFrame]], source: DataFrame | None = None, overrides: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """DataFrame of every node, nothing run yet. A module is called with its ports and params; port source `$` is the pipeline's input; overrides win over params."""
    made: dict[str, DataFrame] = {}
    for n in order(nodes):
        if n.module not in modules:
            raise ValueError(f"unknown module {n.module}")
        ports = {p: source if s == "$" else made[s] for p, s in n.inputs.items()}
        made[n.name] = modules[n.module](**ports, **{**n.params, **(overrides or {}).get(n.name, {})})
    return made


def search_params(profile: dict, caller: dict) -> dict:
    """The caller's settings under those the profile forces."""
    return {**caller, **profile.get("search_kwargs", {})}


#: Knobs with default, lowest and highest value.
KNOBS = {"top_n": (12, 1, 50), "top_k": (200, 1, 500), "rrf_k": (60, 1, 1000), "alpha": (0.5, 0.0, 1.0), "threshold": (0.0, 0.0, 1.0), "rerank_top_n": (12, 1, 200), "chunk_size": (512, 64, 8192), "chunk_overlap": (50, 0, 1024)}


def knob(name: str, value):
    """The value within the knob's range; its default for what is no number."""
    from tarnwick.operators.catalog import clamp

    default, low, high = KNOBS[name]
    return clamp(value, low, high, default)


#: The built-in profiles. Settings that win over the caller's, indexing settings, reranker, whether neighbours are a branch, whether triples are extracted and searched.
PROFILES = {
    "default": {"search_kwargs": {"fusion": "rrf"}},
    "keyword_only": {"search_kwargs": {"vector_similarity_weight": 0.0, "fusion": "rrf"}, "indexing": {"skip_embedding": True}},
    "email": {"search_kwargs": {"fusion": "rrf"}, "indexing": {"hierarchical": "false"}},
    "hippo2": {"search_kwargs": {"fusion": "rrf"}, "graph": True, "knowledge": True},
    "rrf_rerank": {"search_kwargs": {"fusion": "rrf"}, "reranker": "cross_encoder"},
    "rrf_llm_rerank": {"search_kwargs": {"fusion": "rrf"}, "reranker": "chat"},
    "rrf_graph_rerank": {"search_kwargs": {"fusion": "rrf"}, "reranker": "cross_encoder", "graph": True},
    "hippo2_graph_rrf": {"search_kwargs": {"fusion": "rrf"}, "reranker": "cross_encoder", "graph": True, "knowledge": True},
}


def profile(name: str, saved: dict | None = None) -> dict:
    """A whole profile: a saved one wins over the built-in one of its name; an unknown name is the default. Raises on settings that no profile has."""
    got = saved if saved is not None else PROFILES.get(name, PROFILES["default"])
    known = {"search_kwargs": {}, "indexing": {}, "reranker": None, "graph": False, "knowledge": False}
    if extra := set(got) - set(known):
        raise ValueError(f"unknown settings {sorted(extra)}")
    return known | got


def save(nodes: list[Node], spark, path: str) -> None:
    """Write a topology as JSON, whole or not at all."""
    import json

    from tarnwick.sources.store import Files

    Files(spark).write(path, json.dumps(write(nodes), indent=1))


def load(spark, path: str) -> list[Node]:
    import json

    from tarnwick.sources.store import Files

    return read(json.loads(Files(spark).read(path)))
