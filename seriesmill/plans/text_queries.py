"""Queries for text rules (T) over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.scalars import settings_hash
from seriesmill.operators import phrases as A
from seriesmill.operators import textrules as T
from seriesmill.plans import roles as R
from seriesmill.plans.registry import query

WP = f"WITH {R.PROMPTS}"
#: Short strings that stand for the dictionary of phrases, lead actions and reactions in the invented prose.
PHRASES = ["the", "and of", "de la", "ion e", "ere", "und", "que", "ment", "ado", "is th", "der ", "les", "por", "eau", "heit"]
LEAD = r"(?i)(?:the|de|la|und|that|que|of|en|der|el) "
REACTION = r"(?i)(?:tion|heit|ado|eux) "
MODES = ["build", "rise", "attack", "build", "rise", "spell", "build"]
RULES = {"camera": r"(?i)\b(?:camera|pan|zoom|dolly)\b", "capitals": r"^[A-Z]{3,}", "signs": r"[#$%&*]{3,}", "digits": r"[0-9]{3}"}
_WRAPPED = "'Prompt: \"' || coalesce(text, '') || '\" <think>no' || chr(10) || 'way</think>'"


def _wrapped():
    return F.concat(F.lit('Prompt: "'), F.coalesce("text", F.lit("")), F.lit('" <think>no\nway</think>'))


def _clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({x}, '(?is)<think>.*?</think>', '', 'g'), '\\s+', ' ', 'g')), '(?i)^(?:prompt|image-to-video prompt|video prompt)\\s*:\\s*', '', 'g'), '^[ \"''`]+|[ \"''`]+$', '', 'g')"


@query("t1_clean_text", f"SELECT doc_id, {_clean_sql(_WRAPPED)} AS clean FROM documents")
def t1(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.clean_text(_wrapped()).alias("clean"))


_ANSWER = "CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE 'TWO_HANDS_CLEAR: ' || CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'no' END || chr(10) || 'PROMPT: ' || coalesce(text, '') END"


@query("t2_parse_response", f"WITH a AS (SELECT doc_id, {_ANSWER} AS t FROM documents), b AS (SELECT doc_id, t, regexp_extract(t, '(?is)\\bPROMPT\\s*:\\s*(.+)', 1) AS p FROM a) SELECT doc_id, {_clean_sql('CASE WHEN p <> chr(32) AND p <> chr(0) AND length(p) > 0 THEN p ELSE t END')} AS body, lower(regexp_extract(t, '(?i)\\bTWO_HANDS_CLEAR\\s*:\\s*(yes|no)\\b', 1)) = 'yes' AS flag FROM b")
def t2(spark, d):
    t = F.coalesce("text", F.lit(""))
    answer = F.when(F.col("doc_id") % 3 == 0, t).otherwise(F.concat(F.lit("TWO_HANDS_CLEAR: "), F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("no"), F.lit("\nPROMPT: "), t))
    return R.table(spark, d, "documents").select("doc_id", T.parse_response(answer).alias("x")).select("doc_id", "x.body", "x.flag")


_WORDS = r"len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> ''])"


@query(
    "t3_rule_violations",
    "SELECT doc_id, array_to_string([v FOR v IN [CASE WHEN " + _WORDS + " NOT BETWEEN 40 AND 400 THEN 'word_count' END" + "".join(f", CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in RULES.items())
    + ", CASE WHEN len([p FOR p IN ['heitheit', 'tion tion', 'de la la'] IF contains(lower(text), p)]) > 0 THEN 'forbidden_phrase' END] IF v IS NOT NULL], ',') AS violations FROM documents",
)
def t3(spark, d):
    v = T.rule_violations(F.col("text"), 40, 400, RULES, ["heitheit", "tion tion", "de la la"])
    return R.table(spark, d, "documents").select("doc_id", F.array_join(v, ",").alias("violations"))


@query(
    "t4_two_stage_rule",
    r"WITH p AS (SELECT doc_id, text, regexp_matches(text, '(?i) (?:of|de|und) ') AS has, regexp_extract(text, '(?is)^(.*?) (?:of|de|und) ', 1) AS a, regexp_replace(text, '(?is)^.*? (?:of|de|und) ', '') AS b FROM documents) SELECT doc_id, CASE WHEN NOT has THEN 'connector' WHEN NOT regexp_matches(a, '(?i) (?:the|la|der) ') THEN 'buildup' WHEN NOT regexp_matches(b, '(?i) (?:that|que|zu) ') THEN 'payoff' ELSE 'ok' END AS outcome FROM p",
)
def t4(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.two_stage_rule(F.col("text"), "(?i) (?:the|la|der) ", "(?i) (?:that|que|zu) ", "(?i) (?:of|de|und) ").alias("outcome"))


#: What the modes' texts must show, and show behind the connector.
MODE_PATTERNS = {"build": ("(?i)(?:tion|ung) ", "(?i) (?:the|la) "), "rise": ("(?i)(?:ed|en) ", "(?i)er "), "attack": ("(?i)qu", "(?i)(?:ing|ado) ")}
_MODE_OF = "['build', 'rise', 'attack', 'build', 'rise', 'spell', 'build'][doc_id % 7 + 1]"
_SHOWN = "CASE " + " ".join(f"WHEN mode = '{m}' THEN regexp_matches(text, '{a}') AND regexp_matches(b, '{b}')" for m, (a, b) in MODE_PATTERNS.items()) + " ELSE false END"


@query(
    "t4_mode_rule",
    rf"WITH p AS (SELECT doc_id, text, {_MODE_OF} AS mode, regexp_matches(text, '(?i) (?:of|de|und) ') AS has, regexp_extract(text, '(?is)^(.*?) (?:of|de|und) ', 1) AS a, regexp_replace(text, '(?is)^.*? (?:of|de|und) ', '') AS b FROM documents) SELECT doc_id, CASE WHEN mode = 'spell' THEN 'unknown_mode' WHEN NOT has THEN 'connector' WHEN NOT regexp_matches(a, '(?i) (?:the|la|der) ') THEN 'buildup' WHEN NOT regexp_matches(b, '(?i) (?:that|que|zu) ') THEN 'payoff' WHEN NOT {_SHOWN} THEN 'mode' ELSE 'ok' END AS outcome FROM p",
)
def t4_mode(spark, d):
    rule = T.mode_rule(F.col("text"), T.mode_schedule(F.col("doc_id"), MODES), MODE_PATTERNS, "(?i) (?:the|la|der) ", "(?i) (?:that|que|zu) ", "(?i) (?:of|de|und) ")
    return R.table(spark, d, "documents").select("doc_id", rule.alias("outcome"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_BANS = f", bans AS (SELECT run_id, idx, [p FOR p IN {_LIST} IF contains(r, p)][1:4] AS bans FROM (SELECT run_id, idx, lower(coalesce(string_agg(text, ' ') OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS r FROM prompts))"


def bans_sql() -> str:
    return WP + _BANS + " SELECT run_id, idx, array_to_string(bans, ',') AS bans FROM bans"


@query("t5_recent_phrase_bans", bans_sql())
def t5(spark, d):
    return T.recent_phrase_bans(R.prompts(spark, d), PHRASES, 2, 4).select("run_id", "idx", F.array_join("bans", ",").alias("bans"))


#: Every different word of the benchmark's texts with four letters or more, and what two neighbours make: a dictionary of thousands of phrases.
_DICTIONARY = "w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark), dict AS (SELECT DISTINCT p FROM (SELECT unnest(list_concat([x FOR x IN w IF length(x) >= 4], [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS p FROM w))"


@query("t5_bans_from_table", WP + f", {_DICTIONARY}, r AS (SELECT run_id, idx, lower(coalesce(string_agg(text, ' ') OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS r FROM prompts), h AS (SELECT run_id, idx, list(p ORDER BY p)[1:5] AS bans FROM r JOIN dict ON contains(r, p) GROUP BY ALL) SELECT run_id, idx, coalesce(array_to_string(bans, ','), '') AS bans FROM prompts LEFT JOIN h USING (run_id, idx)")
def t5_table(spark, d):
    w = F.split(F.lower("text"), " ")
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    words = R.table(spark, d, "benchmark").select(F.explode(F.concat(F.filter(w, lambda x: F.length(x) >= 4), two)).alias("phrase")).distinct()
    return A.recent_bans(R.prompts(spark, d), words.withColumn("priority", F.lit(1)), 2, 5).select("run_id", "idx", F.array_join("bans", ",").alias("bans"))


_STYLES = {"en": (40, 400), "de": (20, 300), "fr": (30, 350), "es": (10, 200)}
_BY_STYLE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_WORDS} NOT BETWEEN {a} AND {b}" for k, (a, b) in _STYLES.items()) + " END"


@query(
    "t3_rules_table",
    "WITH p AS (SELECT 'phrase_' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS name, lower(array_to_string(string_split(text, ' ')[3:5], ' ')) AS p FROM benchmark), h AS (SELECT doc_id, list(name ORDER BY name) AS names FROM documents JOIN p ON contains(lower(text), p) GROUP BY doc_id) "
    f"SELECT doc_id, array_to_string(list_concat([v FOR v IN [CASE WHEN {_BY_STYLE} THEN 'words' END, CASE WHEN regexp_matches(text, '[#$%&*]{{3,}}') THEN 'signs' END] IF v IS NOT NULL], coalesce(names, [])), ',') AS violations FROM documents LEFT JOIN h USING (doc_id)",
)
def t3_table(spark, d):
    """Word ranges for each language, a pattern, and a phrase of each text of the benchmark."""
    kinds = "name string, kind string, pattern string, least long, most long, style string, priority long"
    few = spark.createDataFrame([("words", "words", None, a, b, lang, 0) for lang, (a, b) in _STYLES.items()] + [("signs", "pattern", "[#$%&*]{3,}", None, None, None, 1)], kinds)
    none = [F.lit(None).cast("long").alias(c) for c in ("least", "most")]
    name = F.concat(F.lit("phrase_"), F.lpad(F.col("item_id").cast("string"), 6, "0"))
    phrases = R.table(spark, d, "benchmark").select(name.alias("name"), F.lit("phrase").alias("kind"), F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("pattern"), *none, F.lit(None).cast("string").alias("style"), F.lit(2).cast("long").alias("priority"))
    return A.with_rules(R.table(spark, d, "documents"), few.unionByName(phrases), style="lang").select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("t6_repeat_lead", WP + f", l AS (SELECT run_id, idx, coalesce(lower(regexp_extract(text, '{LEAD}', 0)), '') AS lead FROM prompts) SELECT run_id, idx, lead, lead <> '' AND len([v FOR v IN coalesce(list(lead) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) IF v = lead]) >= 2 AS repeats FROM l")
def t6(spark, d):
    return T.repeat_lead(R.prompts(spark, d), LEAD).select("run_id", "idx", "lead", "repeats")


_REACT = REACTION.replace("'", "''")


@query("t7_repeat_reaction", WP + f", r AS (SELECT run_id, idx, regexp_matches(text, '{_REACT}') AS reaction FROM prompts) SELECT run_id, idx, reaction AND coalesce(sum(CAST(reaction AS INT)) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) >= 2 AS repeats, NOT reaction OR idx % 5 = 4 AS allowed FROM r")
def t7(spark, d):
    return T.repeat_reaction(R.prompts(spark, d), REACTION).select("run_id", "idx", "repeats", "allowed")


def all_rules_sql() -> str:
    """T5, T6 and T7 of each prompt in one row."""
    return (
        WP + _BANS + f", l AS (SELECT run_id, idx, coalesce(lower(regexp_extract(text, '{LEAD}', 0)), '') AS lead, regexp_matches(text, '{_REACT}') AS reaction FROM prompts) "
        "SELECT run_id, idx, array_to_string(bans, ',') AS bans, lead, lead <> '' AND len([v FOR v IN coalesce(list(lead) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) IF v = lead]) >= 2 AS repeats_lead, "
        "reaction AND coalesce(sum(CAST(reaction AS INT)) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) >= 2 AS repeats_reaction, NOT reaction OR idx % 5 = 4 AS reaction_allowed FROM l JOIN bans USING (run_id, idx)"
    )


@query("t8_near_duplicate_recent")
def t8(spark, d):
    return T.near_duplicate_recent(R.prompts(spark, d)).select("run_id", "idx", F.round("similarity", 6).alias("similarity"), "is_duplicate")


@query(
    "t8_near_duplicate_levenshtein",
    WP + ", n AS (SELECT run_id, idx, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS n FROM prompts), s AS (SELECT a.run_id, a.idx, max(1 - levenshtein(a.n, b.n) / CAST(greatest(1, length(a.n), length(b.n)) AS DOUBLE)) AS s FROM n a LEFT JOIN n b ON b.run_id = a.run_id AND b.idx < a.idx AND b.idx >= a.idx - 8 GROUP BY a.run_id, a.idx) SELECT run_id, idx, round(coalesce(s, 0.0), 6) AS similarity, coalesce(s, 0.0) >= 0.82 AS is_duplicate FROM s",
)
def t8n(spark, d):
    return T.near_duplicate_levenshtein(R.prompts(spark, d)).select("run_id", "idx", F.round("similarity", 6).alias("similarity"), "is_duplicate")


_MODES = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"


@query("t9_mode_schedule", f"SELECT {_MODES}[doc_id % 7 + 1] AS mode, (doc_id * 7 + doc_id // 7) % 12 AS family, count(*) AS n FROM documents GROUP BY ALL")
def t9(spark, d):
    return R.table(spark, d, "documents").groupBy(T.mode_schedule(F.col("doc_id"), MODES).alias("mode"), T.family_rotation(F.col("doc_id"), 12, 7).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("t10_compose_prompt", "SELECT doc_id, 'The camera stays. ' || CASE WHEN " + _WORDS + " BETWEEN 40 AND 400 THEN text ELSE 'The light pulses.' END || ' No cuts.' AS prompt, CASE WHEN " + _WORDS + " BETWEEN 40 AND 400 THEN 'model' ELSE 'fallback' END AS provenance FROM documents")
def t10(spark, d):
    ok = T.word_count(F.col("text")).between(40, 400)
    return R.table(spark, d, "documents").select("doc_id", T.compose_prompt(F.col("text"), ok, "The camera stays. ", " No cuts.", F.lit("The light pulses.")).alias("x")).select("doc_id", "x.prompt", "x.provenance")


@query("t11_migrate_contract", "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 + 4 END AS v, source AS prompt, lang AS status FROM documents) SELECT doc_id, CASE WHEN coalesce(v, 0) < 6 THEN 'new ' || prompt ELSE prompt END AS prompt, CASE WHEN coalesce(v, 0) < 6 THEN 'prompted' ELSE status END AS status, greatest(coalesce(v, 0), 6) AS contract_version FROM c")
def t11(spark, d):
    x = R.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 + 4).alias("contract_version"), F.col("source").alias("prompt"), F.col("lang").alias("status"))
    return T.migrate_contract(x, 6, F.concat(F.lit("new "), "prompt")).select("doc_id", "prompt", "status", "contract_version")


@query("t12_prompt_hash", "SELECT doc_id, sha256(text) AS prompt_sha256 FROM documents")
def t12(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.prompt_hash(F.col("text")).alias("prompt_sha256"))


_BATCH = "source || '-' || (doc_id // 200)"


def _batches(spark, d):
    """Documents of a source in batches of bounded size, more of them in a larger table."""
    return R.table(spark, d, "documents").withColumn("batch", F.expr("source || '-' || CAST(floor(doc_id / 200) AS BIGINT)"))


@query("t12_batch_hash", f"SELECT {_BATCH} AS batch, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), ',' ORDER BY doc_id)) AS batch_sha256 FROM documents GROUP BY ALL")
def t12b(spark, d):
    return T.batch_hash(_batches(spark, d), "batch", "doc_id", "text")


@query("t12_batch_hash_with_settings", f"SELECT {_BATCH} AS batch, sha256('encoder=e5;negative=blur;' || string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), ',' ORDER BY doc_id)) AS batch_sha256 FROM documents GROUP BY ALL")
def t12c(spark, d):
    return T.batch_hash(_batches(spark, d), "batch", "doc_id", "text", {"negative": "blur", "encoder": "e5"})


@query("t13_diversity_assignment", WP + _BANS.replace("2 PRECEDING AND", "8 PRECEDING AND").replace("[1:4]", "[1:12]") + f" SELECT run_id, idx, 'mode: ' || {_MODES}[idx % 7 + 1] || '; effect: ' || CAST((idx * 7 + idx // 7) % 12 AS VARCHAR) || '; reaction: ' || CASE WHEN idx % 5 = 4 THEN 'allowed' ELSE 'none' END || CASE WHEN len(bans) > 0 THEN '; avoid: ' || array_to_string(bans, ', ') ELSE '' END AS assignment FROM bans")
def t13(spark, d):
    return T.diversity_assignment(R.prompts(spark, d), MODES, 12, 7, PHRASES).select("run_id", "idx", "assignment")


@query("f3_pending_clips", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f3(spark, d):
    from seriesmill.operators.joins import pending_clips

    return pending_clips(R.table(spark, d, "documents").select("doc_id"), R.table(spark, d, "labels"), ["doc_id"], F.col("quality") == 1)


@query("f4_batch_members", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f4(spark, d):
    from seriesmill.operators.joins import batch_members

    return batch_members(R.table(spark, d, "documents").select("doc_id", "source"), R.table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("f5_coverage_check", "SELECT DISTINCT sha256(text) AS prompt_sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def f5(spark, d):
    from seriesmill.operators.joins import missing_keys

    docs = R.table(spark, d, "documents").select("doc_id", T.prompt_hash(F.col("text")).alias("prompt_sha256"))
    have = docs.join(R.table(spark, d, "labels").select("doc_id"), "doc_id")
    return missing_keys(docs, have, ["prompt_sha256"])


@query("a7_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a7(spark, d):
    from seriesmill.operators.joins import skip_existing

    return skip_existing(R.table(spark, d, "documents").select("doc_id"), R.table(spark, d, "labels"), "doc_id")


del settings_hash
