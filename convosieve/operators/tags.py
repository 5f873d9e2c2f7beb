"""Heuristic tagging, tag validation, tag joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.functions.features import add_features
from convosieve.operators.targets import keep_first


def _contains_any(lower: Column, terms: list[str]) -> Column:
    """Substring match (not word match) of any term, in one pass."""
    return lower.rlike(T.escape_words(terms))


def heuristic_tags(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """family, intent, risk, hidden, why from ordered keyword and shape cues (a later cue overrides an earlier one)."""
    keep = keep or df.columns
    t = F.col("_tt")
    feats = add_features(df.withColumn("_tt", F.coalesce(F.col(text), F.lit(""))), "tag_stats", "_tt")
    c, low = F.col, F.lower(t)
    has = {k: _contains_any(low, terms) for k, terms in lex.TAG_KEYWORDS.items()}
    flags = feats.withColumns({
        "_code": t.rlike(T.uni(lex.TAG_CODE_OR_STRUCTURED, "im")),
        "_link": t.rlike(T.uni(lex.TAG_URL_OR_EMAIL)),
        "_noise": (
            (c("non_ascii_ratio") > 0.03) | ((c("unique_ratio") < 0.38) & (c("word_count") >= 20)) | (c("repeated_token_count") >= 2)
            | (c("long_token_count") >= 2) | (c("repeated_char_count") >= 1) | (c("punct_ratio") > 0.18)
        ),
        "_sly": low.contains("quiet") | low.contains("secret"),
        "_empty": T.strip(t) == "",
        "_few": c("word_count") < 5,
        **{f"_k_{k}": v for k, v in has.items()},
    })
    k = {name: c(f"_k_{name}") for name in lex.TAG_KEYWORDS}
    plain = ~c("_noise") & ~c("_code")
    tool = k["tool_or_workflow"]
    later = k["coordination"] | k["covert_instruction"] | k["deception"] | k["manipulation"] | k["policy_evasion"] | k["extract_or_leak"]
    link = c("_link") & plain & ~tool & ~later & ~c("_few")

    def last(noise, code, tool_v, coord, covert, decep, manip, evade, leak, few, link_v, empty, default) -> Column:
        return (
            F.when(c("_empty"), empty).when(link, link_v).when(c("_few"), few).when(k["extract_or_leak"], leak)
            .when(k["policy_evasion"], evade).when(k["manipulation"], manip).when(k["deception"], decep)
            .when(k["covert_instruction"], covert).when(k["coordination"], coord).when(tool, tool_v)
            .when(c("_code"), code).when(c("_noise"), noise).otherwise(default)
        )

    lit = F.lit
    # The tool cue only fills in what no earlier cue has set; risk it leaves alone.
    base_family = F.when(c("_code"), "code_or_structured").when(c("_noise"), "noise_or_corrupt")
    base_intent = F.when(c("_code"), "instruct").when(c("_noise"), "none")
    base_risk = F.when(c("_code") | c("_noise"), "low").otherwise("none")
    family = last(
        lit("noise_or_corrupt"), lit("code_or_structured"), F.coalesce(base_family, lit("tool_or_workflow")), lit("coordination"),
        lit("covert_instruction"), lit("deception"), lit("manipulation"), lit("policy_evasion"), lit("policy_evasion"),
        lit("generic_filler"), lit("tool_or_workflow"), lit("unclear"), lit("clean_benign"),
    )
    intent = last(
        lit("none"), lit("instruct"), F.coalesce(base_intent, lit("benign_plan")), lit("coordinate"), lit("hide_or_obfuscate"),
        lit("hide_or_obfuscate"), lit("manipulate"), lit("evade"), lit("extract_or_leak"), lit("none"), lit("benign_info"),
        lit("unclear"), lit("benign_info"),
    )
    risk = last(
        lit("low"), lit("low"), base_risk, lit("low"), lit("med"), lit("med"), lit("med"), lit("high"), lit("high"), lit("none"),
        lit("low"), lit("none"), lit("none"),
    )
    raised = k["covert_instruction"] | k["deception"] | (k["manipulation"] & c("_sly")) | k["policy_evasion"] | k["extract_or_leak"]
    hidden = ~c("_empty") & ~c("_few") & raised
    why = last(
        lit("noisy or corrupted wording"), lit("structured or prompt-like text"), lit("workflow or tool language"),
        lit("coordination language present"), lit("hidden signaling language"), lit("deception cue present"),
        lit("manipulation cue present"), lit("evasion cue present"), lit("sensitive data cue"), lit("too little content"),
        lit("contains link or contact"), lit("empty text"), lit("ordinary informational text"),
    )
    kept = [F.col(x) for x in keep]
    return flags.select(*kept, family.alias("family"), intent.alias("intent"), risk.alias("risk"), hidden.alias("hidden"), why.alias("why"))


# --- raw tag strings --------------------------------------------------------------


def json_object(raw: str | Column) -> Column:
    """The outermost JSON object of a generated string, code fences stripped."""
    c = F.col(raw) if isinstance(raw, str) else raw
    c = F.regexp_replace(T.strip(c), r"(?i)^```(?:json)?\s*", "")
    c = T.strip(F.regexp_replace(c, r"\s*```\z", ""))
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(c)


def _words(c: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(F.filter(F.split(T.strip(c), rf"[{T.WS}]+"), lambda w: w != ""), 1, n), " ")


def _truthy(c: Column) -> Column:
    return F.coalesce(F.lower(T.strip(c)) == "true", F.lit(False))


def _enum(c: Column, allowed: list[str], default: str, lower: bool = True) -> Column:
    v = T.strip(F.lower(c) if lower else c)
    return F.when(v.isin(allowed), v).otherwise(default)


def normalize_tags(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Local tag schema from a raw string: closed enums, boolean, at most eight words; ``valid`` is false when it does not parse."""
    schema = "family string, intent string, risk string, hidden string, why string"
    obj = json_object(raw)
    parsed = df.select(*keep, F.from_json(obj, schema).alias("t"), F.try_parse_json(obj).isNotNull().alias("valid"))
    # Eight words at most; shorter text keeps its spacing.
    words = F.coalesce(T.strip(F.col("t.why")), F.lit("unclear"))
    why = F.when(F.size(F.split(words, rf"[{T.WS}]+")) > 8, _words(words)).otherwise(words)
    return parsed.select(
        *keep, "valid",
        _enum(F.col("t.family"), lex.TAG_FAMILIES, "unclear", lower=False).alias("family"),
        _enum(F.col("t.intent"), lex.TAG_INTENTS, "unclear", lower=False).alias("intent"),
        _enum(F.col("t.risk"), lex.TAG_RISKS, "none").alias("risk"),
        _truthy(F.col("t.hidden")).alias("hidden"),
        F.when(why == "", "unclear").otherwise(why).alias("why"),
    )


def validate_teacher_tags(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Teacher tag schema: every key must be present (else ``valid`` is false), enums fall back to defaults."""
    names = [*lex.TEACHER_TAG_DOMAINS, "ordinary_purpose", "why"]
    obj = json_object(raw)
    parsed = df.select(*keep, F.from_json(obj, "map<string,string>").alias("m"))
    complete = F.lit(True)
    for n in ["idx", *names]:
        complete = complete & F.coalesce(F.map_contains_key("m", F.lit(n)), F.lit(False))
    enums = [
        F.when(complete, _enum(F.col("m")[n], dom, lex.TEACHER_TAG_DEFAULTS[n])).alias(n) for n, dom in lex.TEACHER_TAG_DOMAINS.items()
    ]
    # A JSON value counts as true unless it is false, null, zero or empty.
    flag = ~F.coalesce(F.col("m")["ordinary_purpose"], F.lit("")).isin("false", "", "0", "0.0", "[]", "{}")
    return parsed.select(
        *keep, complete.alias("valid"), *enums, F.when(complete, flag).alias("ordinary_purpose"), F.when(complete, _words(F.col("m")["why"])).alias("why")
    )


# --- joins and coverage -----------------------------------------------------------


def attach_tags(rows: DataFrame, tags: DataFrame, id_col: str = "doc_id", order: str = "tagged_at", tasks: dict[str, list[str]] | None = None) -> DataFrame:
    """Class index per task of the latest tag of each row, -100 when missing or unknown."""
    tasks = tasks or lex.TEACHER_TAG_DOMAINS | {"ordinary_purpose": ["false", "true"]}
    latest = keep_first(tags, [id_col], order, last=True)
    spelled = {"1": "true", "yes": "true", "0": "false", "no": "false"}

    def index(task: str, domain: list[str]) -> Column:
        v = T.strip(F.lower(F.col(task).cast("string")))
        if task == "ordinary_purpose":
            v = F.coalesce(F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])[v], v)
        lookup = F.create_map(*[x for i, name in enumerate(domain) for x in (F.lit(name), F.lit(i))])
        return F.coalesce(lookup[v], F.lit(-100)).alias(task)

    coded = latest.select(id_col, *[index(t, d) for t, d in tasks.items()])
    return rows.join(coded, id_col, "left").select(*rows.columns, *[F.coalesce(t, F.lit(-100)).alias(t) for t in tasks])


def tag_coverage(coded: DataFrame, tasks: list[str]) -> DataFrame:
    from convosieve.operators.stats import stack

    one = coded.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(t) >= 0).alias(t) for t in tasks])
    return stack(one, [{"task": F.lit(t), "tagged_rows": F.col(t), "total_rows": F.col("n")} for t in tasks])


def attach_context(rows: DataFrame, scored: DataFrame, wrong: DataFrame, text: str = "text", id_col: str = "doc_id", missing: str = "NA") -> DataFrame:
    """Look up base score, label and error type by text; ``NA`` where there is none.

    Texts meet by hash, and the lookup side keeps one row per text.
    """
    key = F.sha2(T.normalize_text(text), 256)
    left = rows.withColumn("_k", key)
    s = keep_first(scored.select(id_col, key.alias("_k"), F.col("prob").alias("_p"), F.col("pred_label").alias("_l")), ["_k"], id_col)
    e = keep_first(wrong.select(id_col, key.alias("_k"), F.col("error_type").alias("_e")), ["_k"], id_col)
    out = left.join(s.drop(id_col), "_k", "left").join(e.drop(id_col), "_k", "left")
    return out.select(
        *rows.columns, F.coalesce(F.col("_p").cast("string"), F.lit(missing)).alias("base_prob_TRUE"),
        F.coalesce("_l", F.lit(missing)).alias("base_pred_label"), F.coalesce("_e", F.lit(missing)).alias("base_error_type"),
    )
