"""Text clean-up, identifiers, spectral classes and review notes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

NBSP = " "

# Token lists of the match disposition.
EMISSION_TOKENS = (
    "em*", "emission", "be*", "bestar", "yso", "tt*", "ttauri", "herbig", "pne", "planetarynebula", "blue", "hmx",
)
OTHER_CLASS_TOKENS = (
    "galaxy", "qso", "agn", "white dwarf", "wd*", "brown dwarf", "rgb*", "agb*", "carbon", "c*", "supernova", "snr",
    "hii",
)
GENERIC_TYPES = ("", "*", "star", "unknown", "pm*", "v*", "ir", "x")
KNOWN_PATTERN = r"wolf\s*-?\s*rayet|\bwr\*|\bwn\b|\bwc\b|\bwo\b"

# Clauses of the review note.
NOTE_CONTEXT = {
    "known_wr": "SIMBAD lo clasifica como WR conocido.",
    "catalogued_non_wr": "SIMBAD contiene una clasificación no-WR inequívoca.",
    "emission_or_ambiguous": "SIMBAD aporta un tipo emisivo o ambiguo; no basta para confirmar ni descartar WR.",
    "generic_or_uninformative": "SIMBAD aporta solo una clasificación genérica.",
    "no_exact_match": "Sin coincidencia SIMBAD exacta ni posicional única a 1″; esto no demuestra novedad.",
    "ambiguous_positional_match": "El fallback posicional a 1″ es ambiguo.",
}
NOTE_UNKNOWN = "Contexto SIMBAD no concluyente."
NOTE_END = "Requiere inspección de SED/imágenes y espectroscopía."
NOTE_SENTENCES = {
    "support": "Apoyo de %s modelos; mejor rango individual %s.",
    "espels": "ESP-ELS: %s.",
    "halpha": "Gaia Hα EW=%.3f.",
    "ruwe": "RUWE elevado (%.2f); revisar astrometría.",
    "flags": "WISE cc_flags=%s; revisar contaminación visual.",
}

# Model parameters lifted to columns, numeric but for max_features.
HYPERPARAMETERS = (
    "n_estimators", "max_depth", "min_samples_leaf", "max_features", "learning_rate", "subsample", "colsample_bytree",
    "reg_lambda", "min_child_weight",
)


def clean_scalar(text: Column) -> Column:
    """Non-breaking and repeated white space become one blank; empty text becomes NULL."""
    plain = F.regexp_replace(F.regexp_replace(text, f"{NBSP}|&nbsp;?", " "), r"\s+", " ")
    return F.nullif(F.trim(plain), F.lit(""))


def clean_token(text: Column) -> Column:
    """Trimmed text, with the usual spellings of 'missing' turned into ''."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(trimmed).isin("nan", "none", "<na>"), "").otherwise(trimmed)


def number_after(text: Column, pattern: str, group: int = 1) -> Column:
    """First number captured by ``pattern`` as a long, else NULL."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("long")


def strict_id(alias: Column, prefix: str = "DR3") -> Column:
    """Id from an alias that is exactly ``<prefix> <digits>``."""
    return number_after(F.trim(alias), rf"^{prefix}\s+(\d+)$")


def searched_id(text: Column, prefix: str = r"Gaia\s+DR3") -> Column:
    """Id found anywhere in a text, whatever its case."""
    return number_after(text, rf"(?i)\b{prefix}\s+(\d+)\b")


def first_present(df: DataFrame, candidates: Sequence[str], *, ignore_case: bool = False) -> Column:
    """The first candidate that exists as a column (a plan-time choice), else NULL."""
    by_name = {c.lower() if ignore_case else c: c for c in reversed(df.columns)}
    for candidate in candidates:
        hit = by_name.get(candidate.lower() if ignore_case else candidate)
        if hit is not None:
            return F.col(hit)
    return F.lit(None).cast("string")


def subtype_by_substring(spectral: Column) -> Column:
    """Broad class by substring; both WN and WC give the mixed class."""
    value = F.upper(F.trim(spectral))
    wn, wc = value.contains("WN"), value.contains("WC")
    return (
        F.when(spectral.isNull(), "unknown")
        .when(wn & wc, "WN/WC")
        .when(wn, "WN")
        .when(wc, "WC")
        .when(value.contains("WO"), "WO")
        .otherwise("other")
    )


def subtype_by_word(spectral: Column) -> Column:
    """Broad class by word start, WO first: the rule of the second stage."""
    value = F.coalesce(spectral, F.lit(""))
    wo, wc, wn = (value.rlike(rf"(?i)\b{k}") for k in ("WO", "WC", "WN"))
    return (
        F.when(wo, "WO").when(wc & wn, "WN/WC").when(wc, "WC").when(wn, "WN").otherwise("other_or_missing")
    )


def dataset_family(variant: Column) -> Column:
    return (
        F.when(variant.startswith("strict_"), "strict").when(variant.startswith("relaxed_"), "relaxed").otherwise("unknown")
    )


def astrometric_subset(variant: Column) -> Column:
    return F.regexp_replace(variant, "^(strict|relaxed)_", "")


def joined_label(columns: Sequence[str], sep: str = " / ") -> Column:
    """Non-blank parts joined by ``sep``."""
    return F.concat_ws(sep, *[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns])


def parameter_map(text: Column) -> Column:
    """JSON object as a string map with the estimator prefix removed; bad JSON gives NULL."""
    parsed = F.from_json(text, "map<string,string>")
    return F.transform_keys(parsed, lambda k, _: F.replace(k, F.lit("estimator__"), F.lit("")))


def parameter(params: Column, name: str, kind: str = "double") -> Column:
    return F.try_element_at(params, F.lit(name)).try_cast(kind)


def compact_parameters(params: Column) -> Column:
    """Short text of the parameters that are present."""

    def piece(name: str, label: str, fmt: str) -> Column:
        value = parameter(params, name)
        shown = F.format_string(f"{label}={fmt}", value if "f" in fmt else value.cast("long"))
        return F.when(value.isNotNull(), shown)

    return F.concat_ws(
        " | ",
        piece("n_estimators", "trees", "%d"),
        piece("max_depth", "depth", "%d"),
        piece("learning_rate", "eta", "%.3f"),
        piece("min_samples_leaf", "leaf", "%d"),
        piece("min_child_weight", "child", "%d"),
        piece("subsample", "sub", "%.2f"),
        piece("colsample_bytree", "col", "%.2f"),
        piece("reg_lambda", "lambda", "%.2f"),
    )


def _contains_any(text: Column, tokens: Sequence[str]) -> Column:
    # One alternation of quoted tokens instead of a chain of contains().
    return text.rlike("|".join(re.escape(t) for t in tokens))


def disposition(method: Column, found: Column, main_type: Column, other_types: Column, sp_type: Column) -> Column:
    """Conservative seven-way context of a catalogue match; the order of the rules matters."""
    blank = F.lit("")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, blank) for c in (main_type, other_types, sp_type)]))
    return (
        F.when(F.coalesce(method, blank) == "position_ambiguous", "ambiguous_positional_match")
        .when(~F.coalesce(found, F.lit(False)), "no_exact_match")
        .when(text.rlike(KNOWN_PATTERN), "known_wr")
        .when(_contains_any(text, EMISSION_TOKENS), "emission_or_ambiguous")
        .when(_contains_any(text, OTHER_CLASS_TOKENS), "catalogued_non_wr")
        .when(F.lower(F.trim(F.coalesce(main_type, blank))).isin(list(GENERIC_TYPES)), "generic_or_uninformative")
        .otherwise("emission_or_ambiguous")
    )


def review_note(
    support: Column, best_rank: Column, category: Column, espels: Column, halpha: Column, ruwe: Column, flags: Column
) -> Column:
    """One sentence per available piece of evidence."""
    context = F.lit(NOTE_UNKNOWN)
    for key, clause in NOTE_CONTEXT.items():
        context = F.when(F.coalesce(category, F.lit("no_exact_match")) == key, clause).otherwise(context)
    espels, flags = clean_token(espels), clean_token(flags)
    return F.concat_ws(
        " ",
        F.format_string(NOTE_SENTENCES["support"], support, best_rank),
        context,
        F.when(espels != "", F.format_string(NOTE_SENTENCES["espels"], espels)),
        F.when(halpha.isNotNull(), F.format_string(NOTE_SENTENCES["halpha"], halpha)),
        F.when(ruwe > 1.4, F.format_string(NOTE_SENTENCES["ruwe"], ruwe)),
        F.when(flags.rlike("[^0]"), F.format_string(NOTE_SENTENCES["flags"], flags)),
        F.lit(NOTE_END),
    )


def exclusion_pattern(tokens: Sequence[str]) -> str:
    """One case-insensitive alternation: ``-`` optional, blanks flexible, ``WR*`` as a word start."""
    parts = []
    for token in tokens:
        if token == "WR*":
            parts.append(r"\bwr\*")
        else:
            parts.append(re.escape(token).replace(r"\-", "-?").replace(r"\ ", r"\s*"))
    return "(?i)" + "|".join(parts)
