"""Common parts of the SQL that checks the queries."""

BLANKS = r"[ \t\n\x0B\f\r\x{A0}\x{FEFF}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{BLANKS}+', ' ', 'g')"


def fnv(x: str) -> str:
    return f"format('{{:08x}}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"


def pid(x: str) -> str:
    return f"('p-' || substring({fnv(x)}, 1, 6))"


PARTS = "list_filter(list_transform(string_split(text, chr(10)), lambda q: " + trim("q") + "), lambda q: q <> '')"

#: paras(doc_id, source, lang, pos, offset, text)
PARAS = f"""parts AS (SELECT doc_id, source, lang, {PARTS} AS ps FROM documents),
numbered AS (SELECT doc_id, source, lang, unnest(range(len(ps))) AS pos, unnest(ps) AS text FROM parts),
paras AS (SELECT doc_id, source, lang, pos, (coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", text FROM numbered)"""

#: works(slug, language, total_chapters, total_chars, first_chapter)
WORKS = """by_lang AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, min(doc_id) AS first FROM documents GROUP BY ALL),
picked AS (SELECT source, lang FROM by_lang QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1),
works AS (SELECT b.source AS slug, any_value(p.lang) AS language, sum(n)::BIGINT AS total_chapters, sum(chars)::BIGINT AS total_chars, min(first) AS first_chapter FROM by_lang b JOIN picked p USING (source) GROUP BY b.source)"""


def words_in(x: str, words: str) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words.split())})"
