"""Values that nest deeper than a schema's references are unrolled, to the full depth.

Expressions can't recurse. A row whose references all close within the unrolled levels is validated by one projection. Of the others,
the references left open become rows of their own (definition, path, value), level by level until none is left; then
results go back up the same way: the issues and the normalized value of each are joined to the row that left it open, which looks
them up. So a document's depth costs rounds, never a longer plan, its parts are spread like any rows, and only documents that
are deep take part. Where values can only nest as lists do, a row leaves few references open at a time, and the same rounds are
steps of a loop inside the row's own expression, without a job. An intersection's later parts see a deep part's value as it was given, before the earlier parts' transforms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.plans import ir
from assay.plans.compiler import BELOW, MAX_DEPTH, OPEN, Compiler, Out
from assay.plans.registry import Registry
from assay.plans.values import from_variant, variant_member

from .scratch import written


def _stage(nodes: DataFrame, compiler: Callable[..., Compiler], schema: ir.Schema, pick: Callable[[Out], list], **how) -> DataFrame:
    """Open references' rows, each compiled by its definition and depth."""
    kinds = [(r["name"], r["level"]) for r in nodes.select("name", "level").distinct().collect()]  # at most definitions x depth
    parts = []
    for name, level in sorted(kinds):
        rows = nodes.filter((F.col("name") == name) & (F.col("level") == level))
        target, v = schema.resolve(name), from_variant(F.col("raw"))
        while target["type"] == "ref":
            target = schema.resolve(target["$ref"])
        out = compiler(level=level, **how).node(target, v, F.col("path"), ((name, v),))
        parts.append(rows.select("rid", "key", *pick(out)))
    return reduce(DataFrame.unionByName, parts)


def _each(schema: ir.Schema, compiler: Callable[..., Compiler], pick: Callable[[Out], Column], n: Column, **how) -> Column:
    """``pick`` of an open reference's result; by definition, and level by level where some of its nodes may lie too deep."""
    found = F.lit(None)
    for name in sorted(schema.definitions):
        target, seen = schema.resolve(name), set()
        while target is not None and target["type"] == "ref" and target["$ref"] not in seen:
            seen.add(target["$ref"])
            target = schema.resolve(target["$ref"])
        if target is None or target["type"] == "ref":
            continue

        def at(**where) -> tuple[Column, int]:
            c, v = compiler(**where, **how), from_variant(n["raw"])
            of = lambda v: pick(c.node(target, v, n["path"], ((name, v),)))
            if target["type"] != "object" or not target["properties"]:
                return of(v), c.deepest
            # a member is built anew wherever it is read, so all of them are read once and bound to a name
            members = F.array(F.struct(*[variant_member(n["raw"], key).alias(f"m{k}") for k, key in enumerate(target["properties"])]))
            staged = lambda m: {key: from_variant(m[f"m{k}"]) for k, key in enumerate(target["properties"])}
            return F.get(F.transform(members, lambda m: of(replace(v, staged=staged(m)))), 0), c.deepest

        usual, deepest = at(base=n["level"])
        near = range(max(0, MAX_DEPTH - deepest + 1), MAX_DEPTH + 1)
        got = reduce(lambda other, level: F.when(n["level"] == level, at(level=level)[0]).otherwise(other), near, usual)
        found = F.when(n["name"] == name, got).otherwise(found)
    return found


def _looped(schema: ir.Schema, compiler: Callable[..., Compiler], opened: Column) -> Column:
    """The results of a row's open references, by a loop down to the last of them and one back up."""
    none = F.create_map().cast(BELOW)
    last = lambda levels: F.element_at(levels, -1)
    further = lambda nodes: F.flatten(F.transform(nodes, lambda n: _each(schema, compiler, Out.opened, n, collect=True))).cast(f"array<{OPEN}>")
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), F.array(opened), lambda levels, _: F.when(F.size(last(levels)) == 0, levels).otherwise(F.concat(levels, F.array(further(last(levels))))))
    got = lambda out: F.struct(out.issues().alias("issues"), out.value.as_variant().alias("normal"))
    done = lambda nodes, below: F.transform(nodes, lambda n: F.struct(n["key"].alias("key"), _each(schema, compiler, got, n, below=below).alias("got")))
    results = F.aggregate(F.reverse(levels), none, lambda below, nodes: F.map_from_entries(done(nodes, below)).cast(BELOW))
    return F.when(F.size(opened) == 0, none).otherwise(results)


def resolved(df: DataFrame, schema: ir.Schema, make: Callable[[Compiler], Out], registry: Registry | None, apply_transforms: bool, unroll: int | None) -> tuple[DataFrame, Out]:
    """The frame and the compiled schema over it, with the results of references that were left open. ``make`` compiles over
    ``df``'s columns. A frame of a recursive schema is read once here to find the deep rows; a stream can't be, and keeps
    ``unroll`` levels (4), beyond which values get MAX_DEPTH_EXCEEDED. Elsewhere ``unroll`` changes no result."""
    chained = not df.isStreaming and ir.chained(schema)
    unroll = unroll or (4 if df.isStreaming else 1 if chained else ir.unrolls(schema))

    def compiler(**more) -> Compiler:
        return Compiler(schema, registry, apply_transforms, unroll, **more)

    plain = make(compiler())
    if df.isStreaming or not ir.recursive(schema):
        return df, plain
    found = make(compiler(collect=True))
    if not found.opens:
        return df, plain
    if chained:  # the work is in the rows, however few files they come from
        spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("__opens", found.opened())
        return spread.withColumn("__below", _looped(schema, compiler, F.col("__opens"))).drop("__opens"), make(compiler(below=F.col("__below")))
    given = df.columns
    is_deep = F.size(found.opened()) > 0
    deep = written(df.filter(is_deep).withColumns({"__opens": found.opened(), "__rid": F.monotonically_increasing_id()}))
    edges = written(deep.select(F.col("__rid").alias("rid"), F.lit("").alias("parent"), F.explode("__opens").alias("o")).select("rid", "parent", "o.*"))
    if edges.isEmpty():
        return df, plain
    levels = []
    while not edges.isEmpty():
        levels.append(edges)
        nodes = edges.dropDuplicates(["rid", "key"])
        opened = _stage(nodes, compiler, schema, lambda out: [F.explode(out.opened()).alias("o")], collect=True)
        edges = written(opened.select("rid", F.col("key").alias("parent"), "o.*"))
    below = None
    for edges in reversed(levels):
        nodes = edges.dropDuplicates(["rid", "key"])
        if below is None:
            nodes = nodes.withColumn("below", F.create_map().cast(BELOW))
        else:
            nodes = nodes.join(below.withColumnRenamed("parent", "key"), ["rid", "key"], "left")
        done = _stage(nodes, compiler, schema, lambda out: [F.struct(out.issues().alias("issues"), out.value.as_variant().alias("normal")).alias("got")], below=F.coalesce("below", F.create_map().cast(BELOW)))
        back = edges.select("rid", "parent", "key").join(done, ["rid", "key"])
        below = written(back.groupBy("rid", "parent").agg(F.map_from_entries(F.collect_list(F.struct("key", "got"))).cast(BELOW).alias("below")))
    top = deep.join(below.select(F.col("rid").alias("__rid"), F.col("below").alias("__below")), "__rid").select(*given, "__below")
    usual = df.filter(~is_deep).withColumn("__below", F.create_map().cast(BELOW))
    return usual.unionByName(top), make(compiler(below=F.col("__below")))
