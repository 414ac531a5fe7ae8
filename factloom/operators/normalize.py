"""Canonical keys of extracted action drafts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import staging

FIELDS = ("verb", "primary_object", "primary_actor", "input_state", "output_state")
KINDS = {"verb": "verb", "primary_object": "object", "primary_actor": "role", "input_state": "state", "output_state": "state"}
FALLBACKS = {"verb": "unknown_verb", "primary_object": "unknown_object", "primary_actor": "unknown_actor", "input_state": "unknown_state", "output_state": "unknown_state"}
SUGGESTIONS = ("actor", "object", "verb", "state")


@dataclass(frozen=True)
class NormalizeConfig:
    """Alias tables by kind (role, object, verb, state), reserved slugs and a version.

    ``aliases`` is small and goes into expressions; ``table``, rows of (kind, alias, canonical), may have any size and counts
    where it is given."""

    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    reserved: frozenset[str] = frozenset()
    version: str = "v1"
    table: DataFrame | None = None


def resolve_aliases(slug: Column, table: dict[str, str]) -> Column:
    """The canonical slug of an alias, others unchanged."""
    if not table:
        return slug
    pairs = F.create_map(*(F.lit(x) for kv in sorted(table.items()) for x in kv))
    return F.coalesce(F.element_at(pairs, slug), slug)


#: Bytes of an alias table that may be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def alias_table(aliases: DataFrame, kind: str | None = None) -> DataFrame:
    """(alias, canonical) of a table (kind, alias, canonical), both as slugs: the least canonical of an alias counts; an empty one stands for the alias itself."""
    own = aliases.where(F.col("kind") == kind) if kind is not None else aliases
    slug = lambda c: t.slugify(t.transliterate(F.lower(F.coalesce(F.col(c), F.lit("")))))
    rows = own.select(slug("alias").alias("alias"), slug("canonical").alias("canonical")).where("alias <> ''")
    return rows.groupBy("alias").agg(F.min(F.coalesce(F.nullif("canonical", F.lit("")), "alias")).alias("canonical"))


def resolve_by_table(rows: DataFrame, slug: str, table: DataFrame, to: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with column ``to``: the canonical slug of column ``slug`` by an ``alias_table`` of any size, others unchanged.

    The table's bytes are measured: within the bound it goes to all tasks, beyond it both sides are shuffled by slug, where
    adaptive execution splits slugs that very many rows share. Null slugs stay null."""
    size = table.agg(F.sum(F.octet_length("alias") + F.octet_length("canonical") + 64)).first()[0] or 0
    held = table.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    held = F.broadcast(held) if size <= broadcast_bytes else held.hint("merge")
    joined = rows.join(held, F.col(slug) == F.col("_alias"), "left")
    return joined.withColumn(to, F.coalesce("_canonical", slug)).drop("_alias", "_canonical")


def apply_reserved(slug: Column, reserved: frozenset[str]) -> Column:
    return slug.isin(*sorted(reserved)) if reserved else F.lit(False)


def settle_field(raw: Column, slug: Column, resolved: Column, name: str, config: NormalizeConfig) -> tuple[Column, Column]:
    """(key part, warning or null) of a draft's field from its stripped text, its slug and the slug's canonical form."""
    fallback = FALLBACKS[name]
    blank, empty, held = F.coalesce(raw == "", F.lit(True)), F.coalesce(slug == "", F.lit(True)), apply_reserved(resolved, config.reserved)
    value = F.when(blank | empty | (resolved == "") | held, F.lit(fallback)).otherwise(resolved)
    note = (
        F.when(blank | (~empty & (resolved == "")), F.lit(f"{name} was empty; using fallback '{fallback}'"))
        .when(empty, F.lit(f"{name} normalized to empty; using fallback '{fallback}'"))
        .when(held, F.concat(F.lit(f"{name} '"), resolved, F.lit(f"' is reserved; using fallback '{fallback}'")))
    )
    return value, note


def normalize_field(raw: Column, name: str, config: NormalizeConfig) -> tuple[Column, Column]:
    """(key part, warning or null) of a draft's field."""
    slug = t.slugify(t.transliterate(F.lower(raw)))
    return settle_field(t.strip(raw), slug, resolve_aliases(slug, config.aliases.get(KINDS[name], {})), name, config)


def build_keys(verb: Column, object_: Column, actor: Column, input_state: Column, output_state: Column) -> dict[str, Column]:
    return {
        "action_canonical": F.concat_ws("_", verb, object_),
        "primary_actor_key": actor,
        "primary_object_key": object_,
        "input_state_key": F.concat_ws("__", object_, input_state),
        "output_state_key": F.concat_ws("__", object_, output_state),
    }


def normalize_drafts(drafts: DataFrame, config: NormalizeConfig | None = None) -> DataFrame:
    """Drafts with keys, surface_forms, suggested_canonical, form_list (aliases), warnings and version.

    Null and blank fields get their fallbacks with a warning. Columns of these names that the drafts have already are
    replaced, all others are kept, whatever their names; rows that repeat are drafts of their own."""
    config, p = config or NormalizeConfig(), t.free_prefix(drafts)
    steps = t.once(drafts, {f"{p}slug_{n}": t.slugify(t.transliterate(F.lower(F.col(n)))) for n in FIELDS} | {f"{p}given_{n}": t.strip(F.col(n)) for n in (*FIELDS, "action_label")})
    if config.table is not None:
        tables = {kind: staging.materialize(alias_table(config.table, kind), "aliases") for kind in sorted(set(KINDS.values()))}
        for n in FIELDS:
            steps = resolve_by_table(steps, f"{p}slug_{n}", tables[KINDS[n]], f"{p}name_{n}")
    else:
        steps = steps.withColumns({f"{p}name_{n}": resolve_aliases(F.col(f"{p}slug_{n}"), config.aliases.get(KINDS[n], {})) for n in FIELDS})
    settled = {n: settle_field(F.col(f"{p}given_{n}"), F.col(f"{p}slug_{n}"), F.col(f"{p}name_{n}"), n, config) for n in FIELDS}
    steps = t.once(steps, {f"{p}{what}_{n}": settled[n][k] for n in FIELDS for k, what in enumerate(("key", "note"))})
    keys = build_keys(*(F.col(f"{p}key_{n}") for n in FIELDS))

    def filled(pairs: list[Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("k"), value.alias("v"))

    def given(name: str) -> Column:
        return F.nullif(F.col(f"{p}given_{name}"), F.lit(""))

    label = F.when(F.coalesce(F.col("action_label"), F.lit("")) != "", F.col(f"{p}given_action_label"))
    forms = filled([*(pair(n, given(n)) for n in FIELDS), pair("action_label", label)])
    hinted = [n for n in SUGGESTIONS if f"suggested_{n}_canonical" in drafts.columns]
    hints = [pair(n, F.when(F.coalesce(F.col(f"suggested_{n}_canonical"), F.lit("")) != "", t.strip(F.col(f"suggested_{n}_canonical")))) for n in hinted]
    suggested = filled(hints) if hints else F.expr("cast(map() as map<string,string>)")
    listed = F.array_compact(F.array(*(given(n) for n in ("input_state", "output_state", "verb", "primary_object", "primary_actor"))))
    warnings = F.array_compact(F.array(*(F.col(f"{p}note_{n}") for n in FIELDS)))
    made = {**keys, "surface_forms": forms, "suggested_canonical": suggested, "form_list": listed, "warnings": warnings, "normalization_version": F.lit(config.version)}
    return steps.select(*(c for c in drafts.columns if c not in made), *(c.alias(k) for k, c in made.items()))


def action_collisions(records: DataFrame) -> DataFrame:
    """Action keys with several records in a run: their surface forms in order of first use, never merged.

    Keys that stand once, most of them, are told by the hash of the key, before their forms become rows. The forms of a key
    are reduced to one row each before they are gathered, so a key of very many records stays small."""
    key = F.xxhash64("run_id", "action_canonical").alias("_key")
    own = F.concat("form_list", F.array_compact(F.array(F.element_at("surface_forms", "action_label"))))
    several = records.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    near = records.select(key, "run_id", "action_canonical", "seq", own.alias("own")).join(several.hint("merge"), "_key", "left_semi")
    # of each record a row that counts it (at place 0), and one for each of its forms
    none = F.expr("cast(array() as array<string>)")
    used = near.select("run_id", "action_canonical", "seq", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("own", none))).alias("i", "form"))
    first = used.groupBy("run_id", "action_canonical", "form", (F.col("i") == 0).alias("counts")).agg(F.min(F.struct("seq", "i")).alias("at"), F.count("*").alias("n"))
    forms = F.transform(F.array_sort(F.collect_list(F.when(~F.col("counts"), F.struct("at", "form")))), lambda x: x["form"])
    joined = first.groupBy("run_id", "action_canonical").agg(F.max(F.when(F.col("counts"), F.col("n"))).alias("n_records"), forms.alias("forms")).where("n_records > 1")
    repeated = F.array_repeat("action_canonical", F.col("n_records").cast("int"))
    return joined.select("run_id", "action_canonical", "n_records", F.when(F.size("forms") > 0, F.col("forms")).otherwise(repeated).alias("surface_forms"), F.lit(False).alias("merged"))
