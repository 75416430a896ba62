"""SQL building blocks of the checks. They state each logical table independently of the Spark plans."""

from __future__ import annotations

from .tables import HEBREW_TO, LATIN_FROM

DASH = r"[\x{05BE}\x{2010}-\x{2015}\-]"
MARK = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
HEBREW_MARK = r"[\x{0591}-\x{05BD}\x{05BF}-\x{05C7}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, '{MARK}', '', 'g'), '{DASH}', ' ', 'g')), "
        r"'[^\p{L}?]+', ' ', 'g'))"
    )


def hebrew_norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{HEBREW_MARK}', '', 'g'), '{DASH}', ' ', 'g'), "
        r"'[^\x{05D0}-\x{05EA}?]+', ' ', 'g'))"
    )


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def spell(x: str) -> str:
    return f"translate({x}, '{LATIN_FROM}', '{HEBREW_TO}')"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


DOC_TOKS = f"""doc_toks AS (SELECT doc_id, {toks("replace(text, '?', ' ')")} AS t FROM documents)"""
WORDS = "words AS (SELECT doc_id, i AS pos, t[i + 1] AS word FROM (SELECT doc_id, t, unnest(range(len(t))) AS i FROM doc_toks))"
VOCAB = """vocab AS (SELECT word, count(*) AS n, ln((SELECT count(*) FROM words) / count(*)) AS idf FROM words GROUP BY word)"""
CORPUS = f"{DOC_TOKS}, {WORDS}"

# Readings: benchmark items in lines of eight words.
QUERY_LINES = r"""qw AS (SELECT item_id AS query_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
query_lines AS (SELECT query_id, i AS line_no, array_to_string(w[i * 8 + 1 : i * 8 + 8], ' ') AS text
  FROM (SELECT query_id, w, unnest(range((len(w) + 7) // 8)) AS i FROM qw))"""
QUERY_TOKENS = f"""qt0 AS (SELECT query_id, line_no, t, unnest(range(len(t))) AS i FROM (SELECT query_id, line_no, {toks('text')} AS t FROM query_lines)),
query_tokens AS (SELECT query_id, line_no, t[i + 1] AS token, row_number() OVER (PARTITION BY query_id ORDER BY line_no, i) - 1 AS k FROM qt0)"""
GRAMS = """(SELECT {key}, unnest(list_transform(range(1, len({key}) + 1), lambda i: substr('#' || {key} || '#', i, 3))) AS gram FROM {src})"""

# Weighted distance as a fold over the letters of one word, the row of the table being the state.
CONFUSABLE = "בכ בנ כנ גנ דר דך רך הח הת חת וז וי ון זן םס םמ צץ פף כך נן עצ טמ שע אצ לך גז קה"


def distance(a: str, b: str, confusable: bool = False) -> str:
    pair = ""
    if confusable:
        both = sorted({p for q in CONFUSABLE.split() for p in (q, q[::-1])})
        listed = ", ".join(f"'{p}'" for p in both)
        pair = f"WHEN (ca || cb) IN ({listed}) THEN 0.45::DOUBLE "
    sub = (
        "CASE WHEN ca = cb THEN 0::DOUBLE WHEN ca = '?' OR cb = '?' THEN 0.3::DOUBLE "
        + pair
        + "ELSE 1::DOUBLE END"
    )
    sub = sub.replace("ca", f"substr({a}, i, 1)").replace("cb", f"substr({b}, j, 1)")
    first = f"list_transform(range(len({b}) + 1), lambda j: j * 0.8::DOUBLE)"
    cell = f"least(p[j + 1] + 0.8::DOUBLE, c[j] + 0.8::DOUBLE, p[j] + {sub})"
    row = (
        f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j::DOUBLE]), "
        f"lambda c, jj: list_append(c, {cell.replace('j + 1', 'jj[1]::INT + 1').replace('c[j]', 'c[jj[1]::INT]').replace('p[j]', 'p[jj[1]::INT]').replace(', j, 1', ', jj[1]::INT, 1')}), "
        f"[i * 0.8::DOUBLE])"
    )
    return (
        f"(list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i::DOUBLE]), "
        f"lambda p, ii: {row.replace('[i * 0.8', '[ii[1] * 0.8').replace(', i, 1', ', ii[1]::INT, 1')}, {first}))[len({b}) + 1]"
    )


def similarity(a: str, b: str, max_norm: float, confusable: bool = False) -> str:
    d = distance(a, b, confusable)
    m = f"greatest(len({a}), len({b}))"
    return f"CASE WHEN {d} > {max_norm}::DOUBLE * {m} THEN 0 ELSE greatest(0, 1 - {d} / {m}) END"
