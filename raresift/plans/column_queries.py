"""Projection and scalar-function queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from raresift.functions import hashing, maths, photometry as ph, sky, text
from raresift.operators.dedup import first_per_key
from raresift.plans.registry import query

_COLOURS_SQL = ", ".join(f"{l} - {r} {n}" for n, (l, r) in ph.COLOURS.items() if n != "K_W1")


@query(
    "prj_01_normalise_survey",
    """select source_id, jmag, hmag, kmag, qual, 'catalogue' match_method, cast(null as double) sep_arcsec from (
      select source_id, J jmag, H hmag, Ks kmag, tmass_quality qual, row_number() over (partition by source_id
        order by tmass_id, J, H, Ks, tmass_quality) rn from v_ir) where rn = 1""",
)
def prj_01(t):
    renamed = t.ir.withColumnsRenamed({"J": "jmag", "H": "hmag", "Ks": "kmag", "tmass_quality": "qual"})
    named = renamed.where(F.col("source_id").isNotNull())
    one = first_per_key(named, ["source_id"], ["tmass_id", "jmag", "hmag", "kmag", "qual"])
    return one.select(
        "source_id", "jmag", "hmag", "kmag", "qual",
        F.lit("catalogue").alias("match_method"), F.lit(None).cast("double").alias("sep_arcsec"),
    )


@query(
    "prj_02_first_present",
    """select source_id, main_id simbad_main_id, main_type simbad_main_type, cast(null as string) simbad_sp_type,
      case when trim(main_id) <> '' then true else false end match_found from v_ident""",
)
def prj_02(t):
    df = t.ident
    main_id = text.first_present(df, ["simbad_main_id", "MAIN_ID"], ignore_case=True)
    return df.select(
        "source_id",
        main_id.alias("simbad_main_id"),
        text.first_present(df, ["simbad_main_type", "main_type", "otype"]).alias("simbad_main_type"),
        text.first_present(df, ["SP_TYPE", "sp"]).alias("simbad_sp_type"),
        F.coalesce(F.trim(main_id) != "", F.lit(False)).alias("match_found"),
    )


@query("prj_03_colours", f"select source_id, {_COLOURS_SQL}, Ks - W1 K_W1 from v_pool")
def prj_03(t):
    return ph.with_colours(t.pool).select("source_id", *ph.COLOURS)


@query(
    "prj_04_transforms",
    """select source_id, round(case when x > 0 then log10(x) end, 6) log_x,
      round(sign(x) * ln(1 + abs(x)), 6) signed_x,
      round(sign(y) * (exp(abs(y)) - 1), 6) inverse_x, x > 0 and z > 0 as log_valid from (
      select source_id, G - BP x, BP - RP z, round((G - BP) / 8e0, 3) y from v_core
        where G is not null and BP is not null and RP is not null)""",
)
def prj_04(t):
    df = t.core.dropna(subset=["G", "BP", "RP"]).select(
        "source_id", (F.col("G") - F.col("BP")).alias("x"), (F.col("BP") - F.col("RP")).alias("z")
    )
    x = F.col("x")
    return df.select(
        "source_id",
        F.round(ph.log10_positive(x), 6).alias("log_x"),
        F.round(ph.signed_log1p(x), 6).alias("signed_x"),
        F.round(ph.inverse_signed_log1p(F.round(x / 8.0, 3)), 6).alias("inverse_x"),
        ph.transform_valid(x, F.col("z"), "log10_positive").alias("log_valid"),
    )


@query(
    "prj_05_derived_features",
    """select source_id, W2 - W3 W2_W3, W1 - W3 W1_W3, Ks - W2 K_W2, J - W2 J_W2, G - W1 G_W1,
      round(sqrt(pmra * pmra + pmdec * pmdec), 6) pm_total,
      round(1.0857362047581296e0 / nullif(J_error, 0), 6) J_snr,
      round(1.0857362047581296e0 / nullif(H_error, 0), 6) H_snr,
      round(1.0857362047581296e0 / nullif(Ks_error, 0), 6) Ks_snr from v_pool""",
)
def prj_05(t):
    out = ph.with_derived(t.pool)
    rounded = [F.round(c, 6).alias(c) for c in ("pm_total", "J_snr", "H_snr", "Ks_snr")]
    return out.select("source_id", "W2_W3", "W1_W3", "K_W2", "J_W2", "G_W1", *rounded)


_ALIAS = """select source_id, case when other_types = 'en' then concat('DR3  ', cast(source_id as string))
    when other_types = 'de' then concat('see gaia DR3 ', cast(source_id as string), ' !') else 'HD 1' end alias
    from v_ident"""


@query(
    "prj_06_ids_from_text",
    f"""select source_id, strict, searched, concat('Gaia DR3 ', cast(coalesce(strict, searched) as string)) designation
    from (select source_id, try_cast(nullif(regexp_extract(trim(alias), '^DR3\\s+(\\d+)$', 1), '') as bigint) strict,
      try_cast(nullif(regexp_extract(alias, '(?i)\\bGaia\\s+DR3\\s+(\\d+)\\b', 1), '') as bigint) searched
      from ({_ALIAS})) where strict is not null or searched is not null""",
)
def prj_06(t):
    ids = t.sql(_ALIAS).select(
        "source_id", text.strict_id(F.col("alias")).alias("strict"), text.searched_id(F.col("alias")).alias("searched")
    )
    found = ids.where(F.col("strict").isNotNull() | F.col("searched").isNotNull())
    return found.withColumn(
        "designation", F.concat(F.lit("Gaia DR3 "), F.coalesce("strict", "searched").cast("string"))
    )


@query(
    "prj_07_clean_text",
    """select doc_id, md5(nullif(trim(regexp_replace(regexp_replace(text, chr(160) || '|&nbsp;?', ' ', 'g'),
        '\\s+', ' ', 'g')), '')) cleaned,
      case when lower(trim(lang)) in ('nan', 'none', '<na>') then '' else trim(lang) end token,
      concat_ws('|', lang, source) joined from documents""",
)
def prj_07(t):
    return t.documents.select(
        "doc_id",
        F.md5(text.clean_scalar(F.col("text"))).alias("cleaned"),
        text.clean_token(F.col("lang")).alias("token"),
        F.concat_ws("|", F.array("lang", "source")).alias("joined"),
    )


@query(
    "prj_08_subtype_substring",
    """select source_id, case when spectral_type is null then 'unknown'
      when contains(u, 'WN') and contains(u, 'WC') then 'WN/WC' when contains(u, 'WN') then 'WN'
      when contains(u, 'WC') then 'WC' when contains(u, 'WO') then 'WO' else 'other' end subtype
    from (select *, upper(trim(spectral_type)) u from v_ident)""",
)
def prj_08(t):
    return t.ident.select("source_id", text.subtype_by_substring(F.col("spectral_type")).alias("subtype"))


@query(
    "prj_09_subtype_word",
    """select source_id, case when regexp_matches(s, '(?i)\\bWO') then 'WO'
      when regexp_matches(s, '(?i)\\bWC') and regexp_matches(s, '(?i)\\bWN') then 'WN/WC'
      when regexp_matches(s, '(?i)\\bWC') then 'WC' when regexp_matches(s, '(?i)\\bWN') then 'WN'
      else 'other_or_missing' end subtype from (select source_id, coalesce(spectral_type, '') s from v_ident)""",
)
def prj_09(t):
    return t.ident.select("source_id", text.subtype_by_word(F.col("spectral_type")).alias("subtype"))


@query(
    "prj_10_variant_labels",
    """select result_id, case when starts_with(dataset_variant, 'strict_') then 'strict'
      when starts_with(dataset_variant, 'relaxed_') then 'relaxed' else 'unknown' end family,
      regexp_replace(dataset_variant, '^(strict|relaxed)_', '') subset,
      concat_ws(' / ', nullif(dataset_variant, ''), nullif(feature_set, ''), nullif(model, ''), nullif(sampler, ''),
        nullif(negative_ratio_label, '')) model_label from v_results""",
)
def prj_10(t):
    variant = F.col("dataset_variant")
    return t.results.select(
        "result_id",
        text.dataset_family(variant).alias("family"),
        text.astrometric_subset(variant).alias("subset"),
        text.joined_label(["dataset_variant", "feature_set", "model", "sampler", "negative_ratio_label"]).alias("model_label"),
    )


_PARAMS = """select event_id, case when event_type = 'error' then 'not json' when event_type = 'view' then null
    else replace(replace(props, '"k"', '"estimator__n_estimators"'), '}',
      concat(', "max_features": "sqrt", "learning_rate": ', cast(event_id % 7 as string), '.25}')) end params
    from events"""


@query(
    "prj_11_parameters",
    f"""select event_id, n_estimators, max_features, learning_rate,
      concat_ws(' | ', case when n_estimators is not null then printf('trees=%d', cast(n_estimators as bigint)) end,
        case when learning_rate is not null then printf('eta=%.3f', learning_rate) end) compact from (
      select event_id, try_cast(j ->> '$.estimator__n_estimators' as double) n_estimators,
        j ->> '$.max_features' max_features, try_cast(j ->> '$.learning_rate' as double) learning_rate
      from (select event_id, try_cast(params as json) j from ({_PARAMS})))""",
)
def prj_11(t):
    parsed = t.sql(_PARAMS).withColumn("p", text.parameter_map(F.col("params")))
    return parsed.select(
        "event_id",
        text.parameter(F.col("p"), "n_estimators").alias("n_estimators"),
        text.parameter(F.col("p"), "max_features", "string").alias("max_features"),
        text.parameter(F.col("p"), "learning_rate").alias("learning_rate"),
        text.compact_parameters(F.col("p")).alias("compact"),
    )


_MATCH = """select p_partkey, case p_size % 5 when 0 then 'position_ambiguous' when 1 then 'none' else 'exact' end method,
    p_size % 5 <> 1 found, p_type main_type,
    case p_partkey % 6 when 0 then 'Em*' when 1 then 'WR*' when 2 then 'QSO' when 3 then 'Galaxy pair' else null end other,
    case p_partkey % 8 when 0 then 'WN 5' when 1 then 'F2V' else null end sp from part"""


def _duck_tokens(tokens):
    return " or ".join(f"contains(txt, '{token}')" for token in tokens)


_GENERIC = ", ".join(f"'{g}'" for g in text.GENERIC_TYPES)


@query(
    "prj_12_disposition",
    f"""select p_partkey, case when method = 'position_ambiguous' then 'ambiguous_positional_match'
      when not found then 'no_exact_match'
      when regexp_matches(txt, '{text.KNOWN_PATTERN}') then 'known_wr'
      when {_duck_tokens(text.EMISSION_TOKENS)} then 'emission_or_ambiguous'
      when {_duck_tokens(text.OTHER_CLASS_TOKENS)} then 'catalogued_non_wr'
      when lower(trim(coalesce(main_type, ''))) in ({_GENERIC}) then 'generic_or_uninformative'
      else 'emission_or_ambiguous' end disposition from (
      select *, lower(concat(coalesce(main_type, ''), ' ', coalesce(other, ''), ' ', coalesce(sp, ''))) txt
      from ({_MATCH}))""",
)
def prj_12(t):
    c = F.col
    return t.sql(_MATCH).select(
        "p_partkey",
        text.disposition(c("method"), c("found"), c("main_type"), c("other"), c("sp")).alias("disposition"),
    )


_NOTE = """select source_id, cast(source_id % 3 + 1 as bigint) support, cast(source_id % 97 + 1 as bigint) best_rank,
    case source_id % 4 when 0 then 'known_wr' when 1 then 'catalogued_non_wr' when 2 then 'odd' else null end category,
    case when W1 > 5 then 'beStar' else 'nan' end espels, case when G > 5 then round(G, 3) else null end halpha, ruwe,
    wise_cc_flags flags from v_pool"""


def _duck_context():
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in text.NOTE_CONTEXT.items())
    return f"case coalesce(category, 'no_exact_match') {whens} else '{text.NOTE_UNKNOWN}' end"


@query(
    "prj_13_review_note",
    f"""select source_id, concat_ws(' ', printf('Apoyo de %d modelos; mejor rango individual %d.', support, best_rank),
      {_duck_context()},
      case when e <> '' then printf('ESP-ELS: %s.', e) end,
      case when halpha is not null then printf('Gaia Hα EW=%.3f.', halpha) end,
      case when ruwe > 1.4e0 then printf('RUWE elevado (%.2f); revisar astrometría.', ruwe) end,
      case when regexp_matches(f, '[^0]') then printf('WISE cc_flags=%s; revisar contaminación visual.', f) end,
      '{text.NOTE_END}') note from (select *,
        case when lower(trim(coalesce(espels, ''))) in ('nan', 'none', '<na>') then '' else trim(coalesce(espels, '')) end e,
        case when lower(trim(coalesce(flags, ''))) in ('nan', 'none', '<na>') then '' else trim(coalesce(flags, '')) end f
      from ({_NOTE}))""",
)
def prj_13(t):
    c = F.col
    note = text.review_note(
        c("support"), c("best_rank"), c("category"), c("espels"), c("halpha"), c("ruwe"), c("flags")
    )
    return t.sql(_NOTE).select("source_id", note.alias("note"))


_SIN_P, _COS_P = math.sin(math.radians(sky.POLE_DEC)), math.cos(math.radians(sky.POLE_DEC))
GALACTIC_SQL = f"""select *, ((({sky.POLE_LON}::double - degrees(atan2(cos(d) * sin(a),
        sin(d) * {_COS_P!r}::double - cos(d) * {_SIN_P!r}::double * cos(a)))) % 360e0) + 360e0) % 360e0 gl,
      degrees(asin(greatest(least(sin(d) * {_SIN_P!r}::double + cos(d) * {_COS_P!r}::double * cos(a), 1e0), -1e0))) gb
    from (select *, radians(ra - {sky.POLE_RA}::double) a, radians("dec") d from SRC)"""


@query(
    "prj_14_spatial",
    f"""with g as ({GALACTIC_SQL.replace("SRC", "v_core")}),
    u as (select *, 1e0 / nullif(parallax, 0) dist, coalesce(parallax > 0 and parallax_over_error >= 2
      and 1e0 / nullif(parallax, 0) <= 15, false) usable from g)
    select source_id, round(gl, 6) galactic_l, round(gb, 6) galactic_b,
      round((90 - gb) * sin(radians(gl)), 6) polar_x, round((90 - gb) * cos(radians(gl)), 6) polar_y,
      round(case when usable then dist end, 6) distance_kpc,
      round(case when usable then 8.122e0 - dist * cos(radians(gb)) * cos(radians(gl)) end, 6) plane_x_kpc,
      round(case when usable then dist * cos(radians(gb)) * sin(radians(gl)) end, 6) plane_y_kpc,
      usable distance_plotted from u""",
)
def prj_14(t):
    out = sky.with_spatial(t.core)
    names = ["galactic_l", "galactic_b", "polar_x", "polar_y", "distance_kpc", "plane_x_kpc", "plane_y_kpc"]
    return out.select("source_id", *[F.round(n, 6).alias(n) for n in names], "distance_plotted")


def _newton_sql(steps=12):
    body = """select source_id, -radians((ra + 180e0) % 360e0 - 180e0) lam, radians("dec") phi, radians("dec") th from v_sky"""
    for _ in range(steps):
        body = f"""select source_id, lam, phi, th - case when abs(2 + 2 * cos(2 * th)) > 1e-12
            then (2 * th + sin(2 * th) - pi() * sin(phi)) / (2 + 2 * cos(2 * th)) else 0 end th from ({body})"""
    return f"""select source_id, round(2 * sqrt(2e0) / pi() * lam * cos(th), 6) mollweide_x,
        round(sqrt(2e0) * sin(th), 6) mollweide_y from ({body})"""


@query("prj_15_mollweide", _newton_sql())
def prj_15(t):
    x, y = sky.mollweide(F.col("ra"), F.col("dec"))
    return t.sky.select("source_id", F.round(x, 6).alias("mollweide_x"), F.round(y, 6).alias("mollweide_y"))


@query(
    "prj_16_box_area",
    """select tile_id, round(abs(radians(ra_max - ra_min) * (sin(radians(dec_max)) - sin(radians(dec_min))))
      * (180 / pi()) * (180 / pi()), 6) area_deg2 from v_tiles""",
)
def prj_16(t):
    c = F.col
    area = sky.box_area_deg2(c("ra_min"), c("ra_max"), c("dec_min"), c("dec_max"))
    return t.tiles.select("tile_id", F.round(area, 6).alias("area_deg2"))


_PAYLOAD = ["source_id", "tmass_id", "tmass_quality", "wise_quality", "wise_cc_flags", "region_no"]


@query(
    "prj_17_row_hash",
    "select source_id, md5(concat_ws(chr(1), "
    + ", ".join(f"coalesce(cast({c} as string), chr(0))" for c in _PAYLOAD)
    + ")) source_hash from v_pool",
)
def prj_17(t):
    return t.pool.select("source_id", hashing.row_md5(_PAYLOAD).alias("source_hash"))


@query(
    "prj_18_stable_bucket",
    """select source_id, (BUCKET(concat('42:', cast(source_id as string))) % 10000) bucket,
      (BUCKET(concat('42:', cast(source_id as string))) % 10000) < 2000 holdout from v_core""",
)
def prj_18(t):
    bucket = hashing.md5_bucket(F.col("source_id"), 42)
    return t.core.select("source_id", bucket.alias("bucket"), (bucket < 2000).alias("holdout"))


@query("prj_18_blake_bucket")
def prj_18_blake(t):
    """The digest the split is defined on; no SQL engine here has it."""
    return t.label.select("source_id", hashing.blake_bucket(F.col("source_id"), 42).alias("bucket"))


@query(
    "prj_18_blake_range",
    """select count(*) n, count(distinct source_id) ids, count(*) filter (where source_id is null) without_bucket, true in_range,
      true a_fifth_below from v_label""",
)
def prj_18_blake_range(t):
    """What holds for the digest whatever it is: every id has one bucket in range, a fifth of them under 2000 (to 5 sigma)."""
    rows = prj_18_blake(t)
    share = F.count_if(F.col("bucket") < 2000) / F.count("bucket")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_id", "bucket").alias("ids"),
        F.count_if(F.col("bucket").isNull()).alias("without_bucket"),
        ((F.min("bucket") >= 0) & (F.max("bucket") < 10_000)).alias("in_range"),
        (F.abs(share - 0.2) < 5 * F.sqrt(0.16 / F.count("bucket"))).alias("a_fifth_below"),
    )


@query(
    "prj_19_result_id",
    """select result_id row_id, sha1(concat_ws('|', coalesce(dataset_variant, ''), coalesce(feature_set, ''),
      coalesce(model, ''), coalesce(sampler, ''), coalesce(negative_ratio_label, ''))) result_id from v_results""",
)
def prj_19(t):
    columns = ["dataset_variant", "feature_set", "model", "sampler", "negative_ratio_label"]
    return t.results.select(F.col("result_id").alias("row_id"), hashing.result_id(columns).alias("result_id"))


@query(
    "prj_20_safe_metrics",
    """select result_id, holdout_fp / nullif(n_holdout - positives_holdout, 0) fpr,
      case when holdout_precision = 0 and holdout_recall = 0 then 0
        else 2 * holdout_precision * holdout_recall / nullif(holdout_precision + holdout_recall, 0) end balance,
      coalesce(holdout_recall_at_100, hits_at_100 / nullif(positives_holdout, 0)) recall_at_100,
      cast(null as double) absent, coalesce(greatest((train_f2 - cv_f2) / 0.15e0, 0), 0) gap_ratio from v_results""",
)
def prj_20(t):
    df, c = t.results, F.col
    return df.select(
        "result_id",
        maths.ratio(c("holdout_fp"), c("n_holdout") - c("positives_holdout")).alias("fpr"),
        maths.harmonic_mean(c("holdout_precision"), c("holdout_recall")).alias("balance"),
        maths.prefer_existing(df, "holdout_recall_at_100", maths.ratio(c("hits_at_100"), c("positives_holdout"))).alias(
            "recall_at_100"
        ),
        maths.column_or_null(df, "no_such_metric").alias("absent"),
        maths.positive_ratio(c("train_f2") - c("cv_f2"), 0.15).alias("gap_ratio"),
    )


@query(
    "prj_21_tile_id",
    """select tile_id, replace(printf('ra%06.2f_%06.2f__dec%+06.2f_%+06.2f', ra_min, ra_max, dec_min, dec_max),
      '.', 'p') sky_tile_id from v_tiles""",
)
def prj_21(t):
    c = F.col
    return t.tiles.select(
        "tile_id", sky.tile_id(c("ra_min"), c("ra_max"), c("dec_min"), c("dec_max")).alias("sky_tile_id")
    )


@query(
    "prj_22_delivery_metrics",
    """select result_id as model_key, case model when 'xgboost' then 'XGB' when 'random_forest' then 'RF' else 'LR' end
      classifier, case when sampler is null or sampler in ('', 'none') then 'No oversampling' else upper(sampler) end
      sampling, holdout_fp / nullif(holdout_fp + (n_holdout - positives_holdout - holdout_fp), 0) false_positive_rate,
      positives_holdout / nullif(n_holdout, 0) prevalence,
      concat(coalesce(feature_set, 'all'), ' (', cast(p_partkey as string), ')') label from v_results""",
)
def prj_22(t):
    c = F.col
    negatives = c("n_holdout") - c("positives_holdout")
    # Codes shown in the delivered table.
    classifier = F.when(c("model") == "xgboost", "XGB").when(c("model") == "random_forest", "RF").otherwise("LR")
    sampler = F.coalesce(c("sampler"), F.lit(""))
    return t.results.select(
        c("result_id").alias("model_key"),
        classifier.alias("classifier"),
        F.when(sampler.isin("", "none"), "No oversampling").otherwise(F.upper(sampler)).alias("sampling"),
        maths.ratio(c("holdout_fp"), c("holdout_fp") + (negatives - c("holdout_fp"))).alias("false_positive_rate"),
        maths.ratio(c("positives_holdout"), c("n_holdout")).alias("prevalence"),
        F.format_string("%s (%s)", F.coalesce(c("feature_set"), F.lit("all")), c("p_partkey")).alias("label"),
    )
