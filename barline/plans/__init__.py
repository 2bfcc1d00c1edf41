"""How a query is registered: a function of (spark, sf_dir), with SQL for the same rows beside it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from ..sources import stored

NAME = re.compile(r"\{(\w+)\}")
#: A list of numbers that joins a relation to others of its kind by `e.d = a.d - ahead`.
AHEAD = re.compile(r"CROSS JOIN \(VALUES ([\d(), ]+)\) (\w+)\((\w+)\) JOIN ")


def list_first(text: str) -> str:
    """The text with such lists hinted as broadcast, for Spark, which does not reorder hinted joins.

    Without the hint it joins the two sides by their other keys first, which makes all pairs of sessions, and only then the list.
    """
    return AHEAD.sub(r"CROSS JOIN (SELECT /*+ BROADCAST(v) */ * FROM VALUES \1 AS v(\3)) \2 JOIN ", text)


def register(queries: dict, sql: dict) -> Callable:
    """A decorator: query(name, sql=None) puts the function and its SQL into a module's tables."""

    def query(name: str, text: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            queries[name] = function
            if text:
                sql[name] = text
            return function

        return add

    return query


class Portable:
    """Queries whose steps are one SQL text that Spark and DuckDB both understand: `{name}` stands for a relation.

    A base relation is a DataFrame function in Spark and a chain of WITH steps in DuckDB, written apart from each other; a view is
    a text over other relations. Texts start with SELECT or with steps (`a AS (...), b AS (...) SELECT ...`).
    """

    def __init__(self, queries: dict, sql: dict, parent: Portable | None = None, mark: str = ""):
        """parent: whose relations are known here too; mark: sets written views apart from the parent's where relations are replaced."""
        self.queries, self.sql, self.mark = queries, sql, mark
        self.bases, self.views, self.kept, self.frames = (dict(x) for x in (parent.bases, parent.views, parent.kept, parent.frames)) if parent else ({}, {}, {}, {})

    def base(self, name: str, frame: Callable, steps: str | None = None, relation: str | None = None) -> None:
        """A relation by frame(spark, sf_dir); in DuckDB the table of that name, or `relation` of the WITH steps, which may name others."""
        self.views.pop(name, None)
        self.frames.pop(name, None)
        self.bases[name] = (frame, f"(WITH {steps} SELECT * FROM {relation or name})" if steps else name)

    def view(self, name: str, text: str, kept: tuple[str, ...] = (), frame: Callable | None = None) -> None:
        """kept: the tables that a view follows from whose rows are written once and read again, since many queries share it.

        frame(relation): the same rows by DataFrame code in Spark, for a text of so many joins and groupings that one
        task would hold the buffers of all of them; relation(name) is another relation.
        """
        self.bases.pop(name, None)
        self.frames.pop(name, None)
        self.views[name], self.kept[name] = text, kept
        if frame:
            self.frames[name] = frame

    def query(self, name: str, text: str, about: str) -> None:
        def run(spark, sf_dir):
            out = self.frame(text, spark, sf_dir)  # decimals of literals are doubles in the result
            return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])

        run.__doc__ = about
        self.queries[name], self.sql[name] = run, self.text(text)

    def frame(self, text: str, spark, sf_dir: str):
        """The text as a DataFrame."""
        made = {}
        for n in dict.fromkeys(NAME.findall(text)):
            made[n] = self.relation(n, spark, sf_dir)
        text = list_first(text)
        return spark.sql(text if text.lstrip().startswith("SELECT") else "WITH " + text, **made)

    def relation(self, name: str, spark, sf_dir: str):
        if name in self.bases:
            return self.bases[name][0](spark, sf_dir)
        if self.kept[name]:
            return stored(spark, sf_dir, f"view-{self.mark}{name}", lambda: self._made(name, spark, sf_dir), tables=self.kept[name])
        return self._made(name, spark, sf_dir)

    def _made(self, name: str, spark, sf_dir: str):
        if name in self.frames:
            return self.frames[name](lambda n: self.relation(n, spark, sf_dir))
        return self.frame(self.views[name], spark, sf_dir)

    def text(self, text: str) -> str:
        """The text for DuckDB: relations as WITH steps, each after those it follows from."""
        steps: dict[str, str] = {}

        def add(t: str) -> str:
            for n in NAME.findall(t):
                if n not in steps and (n in self.views or self.bases[n][1] != n):
                    made = add(self.views[n] if n in self.views else self.bases[n][1][1:-1])
                    steps[n] = made if made.lstrip().startswith(("SELECT", "WITH")) else "WITH " + made
            return NAME.sub(lambda m: f"r_{m[1]}" if m[1] in steps else m[1], t)

        own = add(text)
        head = ", ".join(f"r_{n} AS MATERIALIZED ({t})" for n, t in steps.items())
        if own.lstrip().startswith("SELECT"):
            return f"WITH {head} {own}" if head else own
        return f"WITH {head}, {own}" if head else f"WITH {own}"
