"""Texts of results that are small by nature: a tree, a neighbourhood, a state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST = 500


def to_dot(edges: DataFrame, title: str = "graph", most: int = MOST) -> str:
    """DOT text of at most ``most`` edges of (caller, callee), in order of names."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = edges.select("caller", "callee").distinct().orderBy("caller", "callee").limit(most).collect()
    return "\n".join([f"digraph {quote(title)} {{", *(f"  {quote(a)} -> {quote(b)};" for a, b in rows), "}"])


def to_mermaid(links: DataFrame, most: int = MOST) -> str:
    """A Mermaid state diagram of (name, target)."""
    rows = links.select("name", "target").distinct().orderBy("name", "target").limit(most).collect()
    return "\n".join(["stateDiagram-v2", *(f"  {a} --> {b}" for a, b in rows)])


def to_text_tree(edges: DataFrame, root: str, depth: int = 3, most: int = MOST) -> str:
    """An indented call tree; a name is opened once."""
    from ..operators.graph import bfs_callees, induced

    nodes = bfs_callees(edges, root, depth, most)
    below: dict[str, list[str]] = {}
    for a, b in induced(edges, nodes).orderBy("caller", "callee").collect():  # among at most ``most`` nodes
        below.setdefault(a, []).append(b)
    out, opened = [], set()

    def put(name: str, level: int) -> None:
        out.append("  " * level + name + (" ..." if name in opened and below.get(name) else ""))
        if name in opened or level >= depth:
            return
        opened.add(name)
        for child in below.get(name, ()):
            put(child, level + 1)

    put(root, 0)
    return "\n".join(out)


def to_markdown(df: DataFrame, most: int = MOST) -> str:
    rows = df.limit(most).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])
