"""Names, parameter texts and path labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public algorithm ids and display names.
ALGORITHM_NAMES = {
    "hllpp": "HyperLogLog++",
    "hll": "HyperLogLog",
    "ll": "LogLog",
    "pc": "Probabilistic Counting",
    "naive": "Naive",
}
PUBLIC_ALGORITHMS = ("hllpp", "hll", "ll", "pc")

# Display order and labels of hashes, scenarios, pairings and strategies.
HASH_ORDER = ["splitmix64", "xxhash64", "murmurhash3", "siphash24"]
SCENARIO_LABELS = {
    "ctrl": "homogeneous direct",
    "seed_xx": "seed mismatch xxhash64",
    "seed_xx_rev": "seed mismatch xxhash64 (rev)",
    "seed_murmur": "seed mismatch murmurhash3",
    "seed_murmur_rev": "seed mismatch murmurhash3 (rev)",
    "family": "family mismatch xxhash64 -> other",
    "family_rev": "family mismatch other -> xxhash64",
}
PAIRING_ORDER = ["10->14", "14->10", "10->18", "18->10", "14->18", "18->14"]
PAIR_GROUP_ORDER = ["10 vs 14", "10 vs 18", "14 vs 18"]
STRATEGY_ORDER = ["reject", "unsafe_naive_merge", "reduce_then_merge"]


def algorithm_id(name: str) -> str:
    """Normalise an id: lower case, punctuation dropped, ``+`` spelled out."""
    plain = re.sub(r"[^a-z0-9]", "", name.lower().replace("+", "plus"))
    for known in ALGORITHM_NAMES:
        if plain == known:
            return known
    raise ValueError(f"unknown algorithm '{name}'; known: {', '.join(ALGORITHM_NAMES)}")


def algorithm_name(name: str) -> str:
    return ALGORITHM_NAMES[algorithm_id(name)]


def _map_literal(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def normalized_id(name: Column) -> Column:
    spelled = F.replace(F.lower(name), F.lit("+"), F.lit("plus"))
    return F.regexp_replace(spelled, "[^a-z0-9]", "")


def algorithm_name_of(algo: Column) -> Column:
    """Display name of an id column; NULL for unknown ids."""
    return F.try_element_at(_map_literal(ALGORITHM_NAMES), normalized_id(algo))


def scenario_label(scenario: Column) -> Column:
    return F.try_element_at(_map_literal(SCENARIO_LABELS), scenario)


def sanitize(label: Column) -> Column:
    """Runs of other characters become one ``_``; none at the ends; never empty."""
    joined = F.regexp_replace(label, "[^A-Za-z0-9]+", "_")
    trimmed = F.regexp_replace(joined, "^_|_$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("default"))


def sanitized(label: str) -> str:
    """:func:`sanitize` for a name known beforehand."""
    return re.sub(r"[^A-Za-z0-9]+", "_", label).strip("_") or "default"


def params_text(k: Column, length: Column) -> Column:
    """``k=..``, ``k=..,L=..`` or ``L=..`` depending on which part is present."""
    return F.concat_ws(
        ",",
        F.when(k.isNotNull(), F.concat(F.lit("k="), k.cast("string"))),
        F.when(length.isNotNull(), F.concat(F.lit("L="), length.cast("string"))),
    )


def param_value(params: Column, key: str) -> Column:
    """The unsigned number after ``key=``, NULL when the key is missing."""
    found = F.regexp_extract(params, rf"(?:^|,){key}=(\d+)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def strict_param_value(params: Column, key: str) -> Column:
    value = param_value(params, key)
    message = F.concat(F.lit(f"parameter {key} is missing in '"), params, F.lit("'"))
    return F.when(value.isNull(), F.raise_error(message).cast("int")).otherwise(value)


def pair_hash_label(left: str, left_seed: int, right: str, right_seed: int) -> str:
    return f"left={left}_seed={left_seed}__right={right}_seed={right_seed}"


def pair_params_label(left_params: str, right_params: str, strategy: str) -> str:
    return f"left={left_params}__right={right_params}__strategy={strategy}"


def order_of(column: Column, order: list[str]) -> Column:
    """Position of a category in an explicit order, for ``orderBy``; unknown ones last."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def path_fields(path: Column) -> dict[str, Column]:
    """Fields of a result path ``<namespace>/<mode>/<algorithm>/<hash>/<params>/<file>``.

    The folders may carry the names of layout columns, as in ``p_hash=xxhash64``.  Numbers and
    texts that a path does not carry come back as NULL.
    """
    path = F.regexp_replace(path, "/p_(?:namespace|mode|algorithm|hash|params)=", "/")

    def text(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))

    def number(pattern: str) -> Column:
        return text(pattern).cast("int")

    return {
        "namespace": text(r"([^/]+)/[^/]+/[^/]+/[^/]+/[^/]+/[^/]+$"),
        "mode_dir": text(r"([^/]+)/[^/]+/[^/]+/[^/]+/[^/]+$"),
        "algorithm_dir": text(r"([^/]+)/[^/]+/[^/]+/[^/]+$"),
        "hash": text(r"([^/]+)/[^/]+/[^/]+$"),
        "params_dir": text(r"([^/]+)/[^/]+$"),
        "d": text(r"_d_(\d+)(?:/|$)").cast("bigint"),
        "k": number(r"/k_(\d+)(?:_L_\d+)?/[^/]+$"),
        "l": number(r"/(?:k_\d+_)?L_(\d+)/[^/]+$"),
        "scenario": text(r"_hash_mismatch_min_([^/]+?)_d_\d+/"),
        "left_hash": text(r"/left_([^/]+?)_seed_\d+_right_[^/]+?_seed_\d+/"),
        "left_hash_seed": text(r"/left_[^/]+?_seed_(\d+)_right_").cast("bigint"),
        "right_hash": text(r"_right_([^/]+?)_seed_\d+/"),
        "right_hash_seed": text(r"_right_[^/]+?_seed_(\d+)/").cast("bigint"),
        "left_k": number(r"/left_k_(\d+)_"),
        "right_k": number(r"_right_k_(\d+)_"),
        "strategy": text(r"_strategy_([^/]+)/"),
    }
