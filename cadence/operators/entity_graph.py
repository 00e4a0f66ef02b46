"""Feature synthesis over a graph of entities (L1).

Relations ``(parent, key, child, fk)`` form an acyclic graph, in which a child
may have several parents and two entities several relations. Entities are
rolled up in topological order, children first, each one once: its own columns,
parts of its dates, and aggregates of its children; the target also takes the
plain columns of its parents (``direct``). A table that several relations read, or that is rolled up itself, is written once.

Each column carries the depth at which it was made, so one table serves
parents at different depths: a parent takes the columns that still fit into
``depth`` aggregations above the target.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators import cleaning as B
from cadence.operators.encodings import one_hot
from cadence.operators.synthesis import _datetime_transforms, roll_up
from cadence.session import cut_lineage


@dataclass
class Relation:
    parent: str
    key: str
    child: str
    fk: str


@dataclass
class EntityGraph:
    """Entities by name, ``(table, index column)``, and the relations between them."""

    entities: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)

    def entity(self, name: str, df: DataFrame, index: str) -> "EntityGraph":
        self.entities[name] = (df, index)
        return self

    def relate(self, parent: str, key: str, child: str, fk: str) -> "EntityGraph":
        for name, col in ((parent, key), (child, fk)):
            if name not in self.entities or col not in self.entities[name][0].columns:
                raise ValueError(f"no column {name}.{col}")
        self.relations.append(Relation(parent, key, child, fk))
        return self

    def children(self, name: str) -> list[Relation]:
        return [r for r in self.relations if r.parent == name]

    def parents(self, name: str) -> list[Relation]:
        return [r for r in self.relations if r.child == name]

    def order(self, target: str, depth: int) -> list[str]:
        """The target and what lies at most ``depth`` relations below it, children before parents."""
        reach, level = {target}, {target}
        for _ in range(depth):
            level = {r.child for n in level for r in self.children(n)}
            reach |= level
        done: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in open_:
                raise ValueError(f"the relations around {name!r} form a circle")
            if name in done or name not in reach:
                return
            open_.add(name)
            for r in self.children(name):
                visit(r.child)
            open_.discard(name)
            done.append(name)

        visit(target)
        return done

    def _keys(self, name: str) -> set[str]:
        """Columns that identify or relate rows, and so are no values."""
        return {self.entities[name][1]} | {r.fk for r in self.parents(name)} | {r.key for r in self.children(name)}

    def _label(self, r: Relation) -> str:
        """The child's name, with the key in brackets where two relations join the same entities."""
        twin = sum(q.parent == r.parent and q.child == r.child for q in self.relations) > 1
        return f"{r.child}[{r.fk}]" if twin else r.child

    def _direct(self, name: str, df: DataFrame, made: dict[str, int]) -> DataFrame:
        """Plain columns of the parents of ``name`` beside its rows."""
        for r in self.parents(name):
            up, _ = self.entities[r.parent]
            keys = self._keys(r.parent)
            cols = [c for c in up.columns if c not in keys]
            tag = f"{r.parent}[{r.fk}]" if sum(q.parent == r.parent for q in self.parents(name)) > 1 else r.parent
            look = up.filter(F.col(f"`{r.key}`").isNotNull()).dropDuplicates([r.key]) \
                .select(F.col(f"`{r.key}`").alias("__up"), *[F.col(f"`{c}`").alias(f"{tag}.{c}") for c in cols])
            df = df.join(look, F.col(f"`{r.fk}`") == F.col("__up"), "left").drop("__up")
            made.update({f"{tag}.{c}": 1 for c in cols})
        return df

    def synthesize(self, target: str, depth: int = 3, direct: bool = True) -> DataFrame:
        """The target's rows with the features of all entities at most ``depth``
        relations away. Rows whose fk is null or has no parent row count nowhere; a
        parent without children has counts of 0 and other aggregates null."""
        tables: dict[str, tuple[DataFrame, dict[str, int]]] = {}
        order = self.order(target, depth)
        for name in order:
            df, index = self.entities[name]
            made = {c: 0 for c in df.columns}
            keys = self._keys(name)
            df = _datetime_transforms(df, keys)
            made.update({c: 0 for c in df.columns if c not in made})
            if direct and name == target:
                df = self._direct(name, df, made)
            for r in self.children(name):
                if r.child not in tables:
                    continue
                cdf, cmade = tables[r.child]
                fits = [c for c, at in cmade.items() if at < depth and c not in self._keys(r.child)]
                label = self._label(r)
                src = cdf.select(F.col(f"`{r.fk}`").alias("__fk"), *[F.col(f"`{c}`") for c in fits])
                rolled = roll_up(src, "__fk", label, set())
                df = df.join(rolled, F.col(f"`{r.key}`") == F.col("__fk"), "left").drop("__fk")
                count = f"COUNT({label})"
                df = df.withColumn(count, F.coalesce(F.col(f"`{count}`"), F.lit(0)))
                for c in rolled.columns:
                    if c != "__fk":
                        source = next((f for f in sorted(fits, key=len, reverse=True) if c.endswith(f"({label}.{f})")), None)
                        made[c] = 1 + (cmade[source] if source else 0)
            readers = sum(r.child == name and r.parent in order for r in self.relations)
            derived = any(r.child in tables for r in self.children(name))
            # every reader rolls it up in two scans
            tables[name] = (cut_lineage(df) if readers > 1 or readers and derived else df, made)
        return tables[target][0]

    def features(self, target: str, depth: int = 3, encode: list[str] | None = None, top_n: int = 10,
                 direct: bool = True) -> DataFrame:
        """L1 end to end: synthesis, then every category (``encode``, or all text columns
        but keys) as 0/1 columns of its ``top_n`` most frequent values, columns without
        any value dropped, missing numbers replaced by their mean."""
        df = cut_lineage(self.synthesize(target, depth, direct))
        keys = self._keys(target)
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
        for c in texts if encode is None else encode:
            plain = c.replace(".", " ")
            df = one_hot(df.withColumnRenamed(c, plain) if plain != c else df, plain, top_n=top_n)
        return B.impute_mean(df)
