"""Deeply nested records to flat related tables, by adjacency-table shredding.

Every object, list element and scalar of a record becomes one row (rec_id, node, parent, label, ordinal, kind, scalar).
Object nodes are then joined with their scalar children, pivoted to one row per object, and related to each other by
(rec_id, parent). JSON of any depth is shredded by one pass of an Arrow function, without recursion; typed columns of any
nesting (structs, arrays, maps) are shredded by JVM expressions that follow the schema.

Defined cases
* exact second deliveries of a record count once;
* null, empty or unreadable payloads give no rows; null lists and null elements give no rows, but elements keep
  their position; of a key that an object holds twice the last one counts; nesting has no limit;
* a name that is null or blank gives no child row; a parent without a name keeps its children with a null parent;
* an empty table gives an empty result; columns that are not named here are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.runtime import blank_to_null, materialize, ship_package

ADJACENCY = "rec_id bigint, node bigint, parent bigint, label string, ordinal bigint, kind string, scalar string"


def once(df: DataFrame, rid: str) -> DataFrame:
    """Rows without their exact repeats; maps and nested lists are compared by value."""
    return df.withColumn("_same", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)).dropDuplicates([rid, "_same"]).drop("_same")


_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?:(null)|(true)|(false)|(NaN|-?Infinity)|(-?(?:0|[1-9]\d*))(\.\d+)?([eE][+-]?\d+)?)")


def read_json(text: str):
    """The value that json.loads gives, for any depth of nesting; ValueError where the text is no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return read_deep(text)


def read_deep(text: str, constants: bool = True):
    """json.loads without recursion: open containers are on a list. `constants`: whether NaN and infinities are read."""
    skip = lambda i: _BLANKS.match(text, i).end()
    end = len(text)
    open_: list = []  # containers, innermost last
    keys: list = []  # key that waits for its value, per open object; None per open array
    i = skip(0)
    while True:
        # A value begins at i.
        c = text[i : i + 1]
        if c and c in "{[":
            value = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                open_.append(value)
                keys.append(None)
                if c == "{":
                    keys[-1], i = _key(text, i, skip)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _SCALAR.match(text, i)
            if not m or m.group(4) and not constants:
                raise ValueError(f"no value at {i}")
            i = m.end()
            null, true, false, odd, whole, part, power = m.groups()
            value = None if null else True if true else False if false else float(odd.replace("Infinity", "inf")) if odd else float(m.group()) if part or power else int(whole)
        # The value is complete; so may be the containers around it.
        while True:
            i = skip(i)
            if not open_:
                if i != end:
                    raise ValueError(f"text behind the value at {i}")
                return value
            box = open_[-1]
            if isinstance(box, dict):
                box[keys[-1]] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(box, dict):
                    keys[-1], i = _key(text, i, skip)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end at {i}")
            value = open_.pop()
            keys.pop()
            i += 1


def _key(text: str, i: int, skip: Callable[[int], int]) -> tuple[str, int]:
    """The key of an object at i, and where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, skip(i + 1)


def _rows(rec: int, payload: str, out: list[tuple]) -> None:
    try:
        root = read_json(payload)
    except ValueError:
        return
    n = 0
    stack = [(root, -1, None, 0)]
    while stack:
        value, parent, label, ordinal = stack.pop()
        node, n = n, n + 1
        if isinstance(value, dict):
            out.append((rec, node, parent, label, ordinal, "object", None))
            stack.extend((v, node, k, i) for i, (k, v) in enumerate(value.items()))
        elif isinstance(value, list):
            out.append((rec, node, parent, label, ordinal, "array", None))
            stack.extend((v, node, None, i) for i, v in enumerate(value))
        elif isinstance(value, str):
            out.append((rec, node, parent, label, ordinal, "string", value))
        else:
            out.append((rec, node, parent, label, ordinal, "null" if value is None else "boolean" if isinstance(value, bool) else "number", None if value is None else json.dumps(value)))


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in ADJACENCY.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for rec, payload in zip(batch["rec_id"], batch["payload"]):
            if payload:
                _rows(int(rec), payload, out)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


def shred_json(df: DataFrame, rid: str, payload: str) -> DataFrame:
    """Adjacency rows of JSON text; the root has parent -1."""
    ship_package(df.sparkSession)
    return df.select(F.col(rid).cast("bigint").alias("rec_id"), F.col(payload).alias("payload")).where("rec_id is not null and payload is not null").mapInPandas(_shred, ADJACENCY)


def pivot_scalars(adj: DataFrame, *labels: str) -> DataFrame:
    """One row per object that has scalar children among `labels`: rec_id, node, one column per label."""
    kept = adj.where(F.col("label").isin(*labels) & F.col("kind").isin("string", "number", "boolean"))
    return kept.groupBy("rec_id", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(x) for x in labels])


def bare_ref(c: Column) -> Column:
    """`[kind:][namespace/]name` to its name; null where nothing is left."""
    return blank_to_null(F.substring_index(F.regexp_replace(c, r"^[^:]*:", ""), "/", -1))


def catalog_apis(adj: DataFrame) -> DataFrame:
    """Provided APIs of every entity at any depth: child, rec_id, parent, pos, child_name."""
    lists = adj.where(F.col("label") == "provides_apis").select("rec_id", F.col("node").alias("list_node"), F.col("parent").alias("holder"), F.col("kind").alias("list_kind"), F.col("scalar").alias("lone"))
    spec = adj.where((F.col("label") == "spec") & (F.col("kind") == "object")).select("rec_id", F.col("node").alias("holder"), F.col("parent").alias("above"))
    names = pivot_scalars(adj, "name")
    owned = lists.join(spec, ["rec_id", "holder"], "left").withColumn("entity", F.coalesce("above", "holder"))
    owned = owned.join(names.select("rec_id", F.col("node").alias("entity"), F.col("name").alias("entity_name")), ["rec_id", "entity"], "left")

    elements = adj.select("rec_id", F.col("parent").alias("list_node"), F.col("node").alias("api_node"), F.col("ordinal").alias("pos"), "kind", "scalar", "label").where("label is null")
    listed = owned.where("list_kind = 'array'").join(elements, ["rec_id", "list_node"]).select("rec_id", "entity_name", "api_node", "pos", "kind", "scalar")
    lone = owned.where("list_kind <> 'array'").select("rec_id", "entity_name", F.col("list_node").alias("api_node"), F.lit(0).cast("bigint").alias("pos"), F.col("list_kind").alias("kind"), F.col("lone").alias("scalar"))
    api = listed.unionByName(lone).where("kind in ('string', 'object')")
    api = api.join(names.select("rec_id", F.col("node").alias("api_node"), "name"), ["rec_id", "api_node"], "left")
    full = F.when(F.col("kind") == "object", F.col("name")).otherwise(F.col("scalar"))
    return api.select(F.lit("api").alias("child"), "rec_id", F.col("entity_name").alias("parent"), "pos", bare_ref(full).alias("child_name")).where("child_name is not null")


T_ROWS = "array<struct<node:string,parent:string,label:string,ordinal:bigint,kind:string,scalar:string>>"


def shred_typed(df: DataFrame, rid: str, *columns: str, labels: frozenset[str] | None = None) -> DataFrame:
    """Adjacency rows of typed columns, by their schema: rec_id, node, parent, label, ordinal, kind, scalar.

    Nodes are paths as text, the record itself is ''. Elements of a list and entries of a map are children of the node that
    holds them, with the name of the list (the key of the entry) as label and their position; null values give no row.
    `labels`: only these names and what leads to them."""
    none = F.array().cast(T_ROWS)
    text = lambda x: F.lit(x) if isinstance(x, str) else x

    def row(node, parent, label, ordinal, kind: str, scalar=None) -> Column:
        fields = (("node", node), ("parent", parent), ("label", text(label)))
        return F.struct(*[(F.lit(None).cast("string") if c is None else c).alias(k) for k, c in fields], ordinal.cast("bigint").alias("ordinal"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if scalar is None else scalar).alias("scalar"))

    def wanted(name: str, kind: T.DataType) -> bool:
        if labels is None or name in labels:
            return True
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return isinstance(inner, T.StructType) and any(wanted(f.name, f.dataType) for f in inner)

    def value(c: Column, kind: T.DataType, parent: Column, label, ordinal: Column) -> Column:
        at = F.concat(parent, F.lit("/"), text(label), F.lit("/"), ordinal.cast("string"))
        if isinstance(kind, T.StructType):
            below = [value(c[f.name], f.dataType, at, f.name, F.lit(0)) for f in kind if wanted(f.name, f.dataType)]
            return F.when(c.isNotNull(), F.concat(F.array(row(at, parent, label, ordinal, "object")), *below)).otherwise(none)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(c, lambda e, i: value(e, kind.elementType, parent, label, i))), none)
        if isinstance(kind, T.MapType):
            entries = F.transform(F.map_entries(c), lambda e, i: value(e["value"], kind.valueType, at, e["key"].cast("string"), i))
            return F.when(c.isNotNull(), F.concat(F.array(row(at, parent, label, ordinal, "object")), F.coalesce(F.flatten(entries), none))).otherwise(none)
        sort = "string" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "number"
        return F.when(c.isNotNull(), F.array(row(None, parent, label, ordinal, sort, c.cast("string")))).otherwise(none)

    parts = [value(F.col(c), df.schema[c].dataType, F.lit(""), c, F.lit(0)) for c in columns]
    return df.select(F.col(rid).cast("bigint").alias("rec_id"), F.inline(reduce(F.concat, parts)))


WORKLOAD_COLUMNS = ("labels", "containers", "ingress_rules")


def shred_workloads(df: DataFrame, labels: frozenset[str] | None = None) -> DataFrame:
    """Adjacency rows of everything that is nested in workload records."""
    return shred_typed(df, "resource_id", *[c for c in WORKLOAD_COLUMNS if c in df.columns], labels=labels)


def _objects(adj: DataFrame, label: str, *fields: str) -> DataFrame:
    """Objects under a label with their scalar fields: rec_id, node, parent, pos, one column per field."""
    own = adj.where((F.col("label") == label) & (F.col("kind") == "object")).select("rec_id", "node", "parent", F.col("ordinal").alias("pos"))
    return own.join(pivot_scalars(adj, *fields), ["rec_id", "node"], "left")


def container_table(adj: DataFrame) -> DataFrame:
    """Containers of workloads: rec_id, node, pos, name, image, is_init."""
    return _objects(adj, "containers", "name", "image", "is_init").drop("parent")


def env_table(adj: DataFrame) -> DataFrame:
    """Env bindings: rec_id, container (its position), pos, name, source, value, ref_name, ref_key, prefix, optional."""
    names = ("name", "source", "value", "ref_name", "ref_key", "prefix", "optional")
    at = adj.where("label = 'containers' and kind = 'object'").select("rec_id", F.col("node").alias("parent"), F.col("ordinal").alias("container"))
    return _objects(adj, "env", *names).join(at, ["rec_id", "parent"]).select("rec_id", "container", "pos", *names)


def rule_table(adj: DataFrame) -> DataFrame:
    """Ingress rules: rec_id, pos, host, path, path_type, backend_service, backend_port."""
    names = ("host", "path", "path_type", "backend_service", "backend_port")
    return _objects(adj, "ingress_rules", *names).select("rec_id", "pos", *names)


def list_table(adj: DataFrame) -> DataFrame:
    """Elements of the scalar lists of containers: rec_id, container (its position), label (ports or command), pos, value."""
    at = adj.where("label = 'containers' and kind = 'object'").select("rec_id", F.col("node").alias("parent"), F.col("ordinal").alias("container"))
    own = adj.where(F.col("label").isin("ports", "command") & (F.col("kind") != "object"))
    return own.join(at, ["rec_id", "parent"]).select("rec_id", "container", "label", F.col("ordinal").alias("pos"), F.col("scalar").alias("value"))


def workload_children(adj: DataFrame) -> DataFrame:
    """Env bindings and ingress backends: child, rec_id, parent, pos, child_name."""
    objects = adj.where("kind = 'object'")
    flat = pivot_scalars(adj, "name", "host", "backend_service")
    env = objects.where("label = 'env'").join(flat.select("rec_id", "node", F.col("name").alias("env_name")), ["rec_id", "node"])
    env = env.join(flat.select("rec_id", F.col("node").alias("parent"), F.col("name").alias("container_name")), ["rec_id", "parent"], "left")
    env = env.select(F.lit("env").alias("child"), "rec_id", F.col("container_name").alias("parent"), F.col("ordinal").alias("pos"), F.col("env_name").alias("child_name"))
    rules = objects.where("label = 'ingress_rules'").join(flat.select("rec_id", "node", "host", "backend_service"), ["rec_id", "node"])
    rules = rules.select(F.lit("ingress").alias("child"), "rec_id", F.col("host").alias("parent"), F.col("ordinal").alias("pos"), F.col("backend_service").alias("child_name"))
    return env.unionByName(rules).where(blank_to_null("child_name").isNotNull())


def shred_children(k8s: DataFrame, catalog: DataFrame) -> DataFrame:
    """All child rows of workloads and catalog entities with record, parent and position."""
    adj = materialize(shred_json(once(catalog, "record_id"), "record_id", "payload"))
    work = materialize(shred_workloads(once(k8s, "resource_id"), frozenset(("name", "env", "host", "backend_service"))))
    return workload_children(work).unionByName(catalog_apis(adj))


def catalog_entities(adj: DataFrame) -> DataFrame:
    """Entity table: rec_id, node, parent_node (of the enclosing entity, -1 at the top), kind, name, owner, lifecycle.

    An entity is an object with a name and a kind; the object that encloses it is reached over its list.
    """
    flat = pivot_scalars(adj, "kind", "name", "owner", "lifecycle").where("kind is not null and name is not null")
    up = adj.where("kind in ('object', 'array')").select("rec_id", "node", "parent")
    lists = up.select("rec_id", F.col("node").alias("parent"), F.col("parent").alias("above"))
    placed = flat.join(up, ["rec_id", "node"]).join(lists, ["rec_id", "parent"], "left")
    inside = flat.select("rec_id", F.col("node").alias("above"), F.lit(True).alias("inner"))
    placed = placed.join(inside, ["rec_id", "above"], "left")
    return placed.select("rec_id", "node", F.when(F.col("inner"), F.col("above")).otherwise(F.lit(-1)).cast("bigint").alias("parent_node"), "kind", "name", "owner", "lifecycle")


def entity_links(entities: DataFrame) -> DataFrame:
    """Entities with the name of the entity that encloses them: rec_id, kind, name, owner, lifecycle, parent_name."""
    above = entities.select("rec_id", F.col("node").alias("parent_node"), F.col("name").alias("parent_name"))
    return entities.join(above, ["rec_id", "parent_node"], "left").select("rec_id", "kind", "name", "owner", "lifecycle", "parent_name")
