"""Queries over structured_data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.nested import child_table, explode_level, json_nodes, list_items, map_nodes, merged_schema, objects
from pagewright.session import table


def nodes(spark: SparkSession, sf_dir: str, items: bool = True) -> DataFrame:
    """All nodes of jsonld and opengraph, scalars in lists included unless told otherwise."""
    data = table(spark, sf_dir, "structured_data")
    return json_nodes(data, "page_id", "jsonld", items).unionByName(map_nodes(data, "page_id", "opengraph", "og:"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, node_path, parent_path) of every object and every opengraph key."""
    return nodes(spark, sf_dir, items=False).select("page_id", "node_path", "parent_path")


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of all child tables."""
    return merged_schema(nodes(spark, sf_dir))


def p5_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, node_path, field, value): the scalar members of all nodes."""
    return nodes(spark, sf_dir).select("page_id", "node_path", F.explode("fields").alias("field", "value"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, node_path, parent_path, ordinals, kind, value): the scalars in lists, with all their places."""
    return list_items(nodes(spark, sf_dir)).select("page_id", "node_path", "parent_path", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"), "kind", "value")


def p5_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, node_path, parent_path, member, ordinals): the tables one level below the tops."""
    every = nodes(spark, sf_dir)
    tops = objects(every).where("schema_path = '$[]'")
    below = explode_level(objects(every), tops)
    return below.select("page_id", "node_path", "parent_path", "member", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"))


def p5_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of the objects in @graph lists, with the columns of its merged schema that are asked for."""
    own = nodes(spark, sf_dir).where("schema_path = '$[].@graph[]'")
    t = child_table(own, "$[].@graph[]", ["@type", "name"])
    return t.select("page_id", "node_path", "parent_path", "ordinal", F.col("@type").alias("type"), "name")


def p5_opengraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, node_path, parent_path, content) of the opengraph keys."""
    data = map_nodes(table(spark, sf_dir, "structured_data"), "page_id", "opengraph", "og:")
    return data.select("page_id", "node_path", "parent_path", F.try_element_at("fields", F.lit("content")).alias("content"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("p5_")}
_OG = r"""
(with k as (select page_id, opengraph m, unnest(map_keys(opengraph)) k from structured_data)
select page_id, 'og:' || k node_path, case when contains(k, ':') and list_contains(map_keys(m), regexp_extract(k, '^(.*):[^:]*$', 1)) then 'og:' || regexp_extract(k, '^(.*):[^:]*$', 1) else '' end parent_path,
 m[k] content from k)"""
# every value of the valid elements, with its path, its nearest object's and its parent's type
_TREE = r"""
(with recursive e as (select page_id, i, t from (select page_id, generate_subscripts(jsonld, 1) - 1 i, unnest(jsonld) t from structured_data) where t is not null and json_valid(t) and not regexp_matches(t, ',\s*[}\]]|NaN|/\*|//\s')),
v as (select page_id, i, t::json j from e where json_type(t) = 'OBJECT'),
t as (select v.page_id, v.i, x.key, x.value, x.type, x.id, x.parent, x.atom from v, json_tree(v.j) x),
r as (select page_id, i, id, '$[' || i || ']' p, '' up, '$[' || i || ']' near, type, '$[]' sp, null::varchar member, i::varchar ords, atom, null::varchar key, '' holder from t where parent is null
union all
select t.page_id, t.i, t.id, r.p || case when r.type = 'ARRAY' then '[' || t.key || ']' else '.' || t.key end, r.near, case when t.type = 'OBJECT' then r.p || case when r.type = 'ARRAY' then '[' || t.key || ']' else '.' || t.key end else r.near end, t.type,
 r.sp || case when r.type = 'ARRAY' then '[]' else '.' || t.key end, case when r.type = 'ARRAY' then r.member else t.key end, case when r.type = 'OBJECT' then '' when r.ords = '' then t.key else r.ords || ',' || t.key end, t.atom, t.key, r.type
from t join r on t.page_id = r.page_id and t.i = r.i and t.parent = r.id)
select *, case type when 'OBJECT' then 'object' when 'ARRAY' then 'list' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end kind, case when type in ('OBJECT', 'ARRAY', 'NULL') then null else atom::json ->> '$' end v from r)"""
_OG_KINDS = "select 'og:' || k sp, 'content' field, case when v is null then 'null' else 'string' end kind from (select unnest(map_keys(opengraph)) k, unnest(map_values(opengraph)) v from structured_data)"
SQL = {
    "p5_opengraph": f"select * from {_OG}",
    "p5_found": f"select page_id, p node_path, up parent_path from {_TREE} where type = 'OBJECT' union all select page_id, node_path, parent_path from {_OG}",
    "p5_fields": f"select page_id, up node_path, key field, v \"value\" from {_TREE} where holder = 'OBJECT' and v is not null union all select page_id, node_path, 'content', content from {_OG} where content is not null",
    "p5_items": f"select page_id, p node_path, up parent_path, ords ordinals, kind, v \"value\" from {_TREE} where holder = 'ARRAY' and type not in ('OBJECT', 'ARRAY')",
    "p5_children": f"select page_id, p node_path, up parent_path, member, ords ordinals from {_TREE} where type = 'OBJECT' and regexp_matches(up, '^\\$\\[[0-9]+\\]$')",
    "p5_graph": f"select page_id, p node_path, up parent_path, ords::int ordinal, k.t \"type\", k.n \"name\" from {_TREE} r left join (select page_id pid, up u, max(v) filter (key = '@type') t, max(v) filter (key = 'name') n from {_TREE} where holder = 'OBJECT' group by 1, 2) k on k.pid = r.page_id and k.u = r.p where sp = '$[].@graph[]' and type = 'OBJECT'",
    "p5_schema": f"select schema_path, field, kind, count(*) n from (select regexp_replace(sp, '\\.' || regexp_escape(key) || '$', '') schema_path, key field, kind from {_TREE} where holder = 'OBJECT' union all select sp, '', kind from {_TREE} where holder = 'ARRAY' and type not in ('OBJECT', 'ARRAY') union all {_OG_KINDS}) group by all",
}
