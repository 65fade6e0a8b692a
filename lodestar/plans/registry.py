"""Rule names, groups and levels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.model import Check, Rule

RULES: dict[str, Rule] = {}

# Rule groups and similarity levels.
GROUPS: dict[str, list[str]] = {
    "basico": ["nullity", "duplicates", "types", "ranges", "patterns", "uniqueness", "referential", "cardinality", "distributions", "correlations"],
    "formato": ["email_valid", "special_chars", "string_length", "trim_check", "case_check", "phone_valid", "zip_valid", "rfc_curp"],
    "fechas": ["invalid_dates", "date_range", "date_inconsistency", "freshness", "latency"],
    "negocio": ["cross_consistency", "functional_dependency", "class_balance", "boolean_bias", "derived_columns"],
    "avanzadas": ["row_completeness", "multivariate_outliers", "drift", "schema_evolution"],
    "integridad": ["volume_anomaly", "sequential_integrity", "missing_fks"],
    "personas": ["fuzzy_name_match", "fuzzy_id_match", "similar_dob", "person_composite_similarity", "personas_similares"],
    "personas_similares": ["personas_similares"],
}
LEVELS: dict[str, list[str]] = {
    "ninguno": [],
    "rapido": ["fuzzy_id_match", "similar_dob"],
    "medio": ["fuzzy_id_match", "similar_dob", "fuzzy_name_match"],
    "profundo": ["fuzzy_id_match", "similar_dob", "fuzzy_name_match", "person_composite_similarity"],
}


def rule(key: str, name: str, description: str, severity: str = "error") -> Callable[[Callable[..., Check]], Callable[..., Check]]:
    """Registers a check under ``key``."""

    def add(check: Callable[..., Check]) -> Callable[..., Check]:
        RULES[key] = Rule(key, name, severity, description, check)
        return check

    return add


def load() -> None:
    """Imports the modules whose checks register themselves."""
    from lodestar.operators import business, completeness, custom, entity, formats, integrity, statistics, temporal  # noqa: F401


def resolve(wanted: str | Iterable[str]) -> list[Rule]:
    """Rules by key, ``all`` or ``todo``, ``grupo:x`` or ``nivel:x``, comma-separated or listed; each once, unknown names left out."""
    load()
    names = [w.strip() for w in (wanted.split(",") if isinstance(wanted, str) else wanted)]
    keys: list[str] = []
    for n in names:
        kind, _, rest = n.partition(":")
        if n in ("all", "todo"):
            keys += [k for k in RULES if not k.startswith("custom_")]
        elif kind == "grupo":
            keys += resolve_keys(GROUPS.get(rest, list(RULES) if rest == "todo" else []))
        elif kind == "nivel":
            keys += LEVELS.get(rest, [])
        else:
            keys.append(n)
    return [RULES[k] for k in dict.fromkeys(keys) if k in RULES]


def resolve_keys(keys: Iterable[str]) -> list[str]:
    return [k for k in keys if k in RULES and not k.startswith("custom_")]


def catalog(spark: SparkSession) -> DataFrame:
    """(key, rule_name, severity, description, rule_group) of all rules; a rule of no group has null."""
    load()
    home = {k: g for g, ks in GROUPS.items() if g != "personas_similares" for k in ks}
    return spark.createDataFrame([(r.key, r.name, r.severity, r.description, home.get(r.key)) for r in RULES.values()], "key string, rule_name string, severity string, description string, rule_group string")
