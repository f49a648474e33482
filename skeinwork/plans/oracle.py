"""DuckDB SQL of the catalogue's queries, written apart from them."""

from __future__ import annotations

import re

from .corpus import CONTENT, FULL, SOURCE

SQL: dict[str, str] = {}


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


# the oracle's own copies of the interface's word sets and of what a word is
STOP = _list(
    "a about abstract after al all also an and any appendix are article articles articulo articulos artículo artículos as at been before but by can clause "
    "clauses com commission con consejo contents copyright could council de del des directive directives document documents dos ebook ebooks esta estas "
    "este estos europea european europeas europeo europeos figure for foundation from guide gutenberg had has have her him his how html index into "
    "introduction its las less ley leyes license like los markdown may might more new not notes notice our overview para parlamento parliament per por "
    "present presente presentes project que reglamento reglamentos regulation regulations section should table text than that the their them then they this "
    "txt una unas union unión uno unos use used using via was were what when where who why will with would you your"
)
LOW = _list(
    "archive copyright donate donations ebook ebooks foundation gutenberg license project trademark"
)
GENERIC_A = _list(
    "abstract appendix chapter contents figure html index introduction markdown notice overview pdf section table text txt version"
)
SHORT = _list(
    "ai api db eu id ml sdk ui uk us ux"
)
NOISE = _list(
    "doc docx html jpeg jpg json md pdf png txt"
)
GENERIC_S = _list(
    "a all and any appendix ascii before chapter chorus copyright distribute e.g ebook etc first full gutenberg i.e king license prince project queen "
    "second start the u.s war"
)
WORD = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_-]*"
SUFFIXES = "md|markdown|txt|pdf|docx|htm|html|py|js|jsx|ts|tsx|json|yml|yaml|toml|ini|cfg|csv|sql|ipynb"
ROMAN = "M{0,4}(CM|CD|DC{0,3}|C{0,3})(XC|XL|LX{0,3}|X{0,3})(IX|IV|VI{0,3}|I{0,3})"
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def is_token(x: str) -> str:
    return f"length({x}) >= 3 AND NOT list_contains({STOP}, {x}) AND NOT regexp_full_match({x}, '[ivxlcdm]+') AND NOT regexp_full_match({x}, '{DIGITS}')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{WORD}'), lambda x: {is_token('x')})"


def estimate(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\r\f\x0b]'))"


def unnested(x: str, value: str, source: str, keep: str) -> str:
    """keep, pos from 0 and value of each element of a list."""
    return f"SELECT {keep}, unnest(range(len(l))) AS pos, unnest(l) AS {value} FROM (SELECT {keep}, {x} AS l FROM {source})"


def firsts(inner: str, keep: str, value: str, limit: int | None = None, sep: str = "|") -> str:
    """The first occurrences of values (pos, value) of each keep, joined in order."""
    cut = f"WHERE n <= {limit}" if limit else ""
    return f"""SELECT {keep}, string_agg({value}, '{sep}' ORDER BY pos) AS v FROM (
      SELECT *, row_number() OVER (PARTITION BY {keep} ORDER BY pos) AS n FROM (SELECT {keep}, {value}, min(pos) AS pos FROM ({inner}) GROUP BY {keep}, {value})) {cut} GROUP BY {keep}"""


NOTES = f"notes AS (SELECT doc_id, {SOURCE} AS original_source, {FULL} AS full_path, {CONTENT} AS content FROM (SELECT doc_id, text, (SELECT count(*) FROM documents) AS n FROM documents))"

# --- text ---

SQL["tokenize_documents"] = f"SELECT doc_id, pos::INT AS pos, term FROM ({unnested(tokens('text'), 'term', 'documents', 'doc_id')})"
SQL["keywords_ordered"] = f"""SELECT d.doc_id, coalesce(v, '') AS keywords FROM documents d LEFT JOIN (
  {firsts(unnested(tokens('text'), 'term', 'documents', 'doc_id'), 'doc_id', 'term', 8)}) k ON d.doc_id = k.doc_id"""
SQL["token_counts"] = f"SELECT doc_id, {estimate('text')}::INT AS tokens FROM documents"


def stem(x: str) -> str:
    root = f"{x}[:-4]"
    return f"""CASE WHEN {x} LIKE '%ies' AND length({x}) > 5 THEN {x}[:-4] || 'y'
      WHEN {x} LIKE '%ing' AND length({x}) > 6 THEN CASE WHEN right({root}, 1) = left(right({root}, 2), 1) THEN {x}[:-5] WHEN regexp_matches({root}, '(ach|at|iz|ov)$') THEN {root} || 'e' ELSE {root} END
      WHEN {x} LIKE '%ed' AND length({x}) > 5 THEN {x}[:-3] WHEN {x} LIKE '%es' AND length({x}) > 5 THEN {x}[:-3] WHEN {x} LIKE '%s' AND length({x}) > 4 THEN {x}[:-2] ELSE {x} END"""


def search_tokens(x: str) -> str:
    raw = rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*'), lambda r: regexp_matches(r, '[-\p{{Nd}}]'))"
    parts = rf"flatten(list_transform({raw}, lambda r: regexp_extract_all(r, '[\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}+')))"
    fragment = rf"f <> '' AND NOT list_contains({NOISE}, f) AND CASE WHEN regexp_full_match(f, '\p{{Nd}}+') THEN length(f) >= 2 ELSE list_contains({SHORT}, f) OR (regexp_full_match(f, '{WORD}') AND {is_token('f')}) END"
    return f"list_concat(list_transform({tokens(x)}, lambda t: {stem('t')}), list_filter(list_transform({parts}, lambda t: {stem('t')}), lambda f: {fragment}))"


SQL["search_tokens"] = f"WITH {NOTES} SELECT doc_id, pos::INT AS pos, term FROM ({unnested(search_tokens('content'), 'term', 'notes', 'doc_id')})"


def low_signal(x: str) -> str:
    hits = " + ".join(rf"regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])')::INT" for t in re.findall("[a-z]+", LOW))
    return f"(contains(lower({x}), 'project gutenberg') OR {hits} >= 4)"


SQL["low_signal_flags"] = f"WITH {NOTES} SELECT doc_id, {low_signal('content')} AS low_signal FROM notes"

# --- Markdown ---


def headings(x: str) -> str:
    """Lists of headings; a line that is both ATX and underlined doesn't occur here."""
    one = f"""CASE WHEN regexp_matches(h, '^#{{1,6}}\\s') THEN regexp_extract(h, '^(#{{1,6}})', 1) || ' ' || regexp_extract(h, '^#{{1,6}}\\s+(.+)', 1)
      ELSE CASE WHEN regexp_matches(h, '\\n=') THEN '# ' ELSE '## ' END || {strip("split_part(h, chr(10), 1)")} END"""
    return f"list_transform(regexp_extract_all({x}, '(?m)^#{{1,6}}\\s+.+$|^.+\\n(?:=+|-+)\\s*$'), lambda h: translate({one}, '‘’“”', chr(39) || chr(39) || '\"\"'))"


def plain_heading(x: str) -> str:
    return strip(f"regexp_replace({x}, '^#+', '')")


SQL["headings_extracted"] = f"WITH {NOTES} SELECT doc_id, pos::INT AS pos, heading FROM ({unnested(headings('content'), 'heading', 'notes', 'doc_id')})"
TABLES = r"len(regexp_extract_all({x}, '(?m)(?:^\|.+\|$\n?){{2,}}'))"
IMAGES = r"len(regexp_extract_all({x}, '!\[[^\]]*\]\([^)]+\)'))"
BARE = r"regexp_replace(regexp_replace({x}, '\{{\{{#[\p{{L}}\p{{N}}_]+[^}}]*\}}\}}', '', 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
SQL["markdown_counts"] = f"WITH {NOTES} SELECT doc_id, {TABLES.format(x='content')}::INT AS tables, {IMAGES.format(x='content')}::INT AS images, length({BARE.format(x=chr(39) + '{{#include a.md}}<b>x</b>' + chr(39) + ' || content')})::INT AS bare_length FROM notes"
SQL["quote_normalised"] = """SELECT doc_id, translate('“' || translate(text, 'aeio', '‘’“”') || '”', '‘’“”', chr(39) || chr(39) || '""') AS text FROM documents"""
FRONTED = "'---' || chr(10) || 'title: Note' || chr(10) || 'k: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || content"
SQL["frontmatter_body"] = rf"WITH {NOTES} SELECT doc_id, regexp_extract({FRONTED}, '(?s)\A---\n(.*?)\n---\n\n?', 1) AS front, md5(regexp_replace({FRONTED}, '(?s)\A---\n(.*?)\n---\n\n?', '')) AS body FROM notes"
MARKED = "'About' || chr(10) || '*** START OF THE BOOK ***' || chr(10) || text || chr(10) || '*** End of the book' || chr(10) || 'after'"
INSIDE = strip("text")  # the markers stand at both ends
SQL["gutenberg_strip"] = f"SELECT doc_id, md5({INSIDE}) AS text FROM documents"
SQL["text_convert"] = f"SELECT doc_id, 'note_' || doc_id AS title, md5('# note_' || doc_id || chr(10) || chr(10) || {INSIDE}) AS content, 0 AS tables, 0 AS images FROM documents"
CONVERTED = BARE.format(x="regexp_replace(" + strip(FRONTED) + r", '(?s)\A---\n(.*?)\n---\n\n?', '')")
SQL["markdown_convert"] = f"""WITH {NOTES}, c AS (SELECT doc_id, {CONVERTED} AS content FROM notes), h AS (SELECT *, {headings('content')} AS hs FROM c)
SELECT doc_id, {plain_heading('hs[1]')} AS title, md5(content) AS content, array_to_string(hs, '|') AS headings, {TABLES.format(x='content')}::INT AS tables, {IMAGES.format(x='content')}::INT AS images FROM h"""
SQL["text_helpers"] = f"""WITH {NOTES}, h AS (SELECT *, {headings('content')} AS hs FROM notes)
SELECT doc_id, array_to_string(list_transform(hs[:4], lambda x: {plain_heading('x')}), '|') AS samples,
  original_source || '|' || full_path || CASE WHEN original_source = split_part(full_path, '/', 3) THEN '' ELSE '|note_' || doc_id || '.md' END AS aliases,
  'docs/chunks/note_' || doc_id || '_007.md' AS chunk_7, 'docs/chunks/note_' || doc_id || '_1234.md' AS chunk_1234 FROM h"""


def unentitied(x: str) -> str:
    """The entities that the pages hold as characters."""
    return f"""replace(replace(replace({x}, '&quot;', '"'), '&middot;', '·'), '&amp;', '&')"""


def unescaped(x: str) -> str:
    """Text of a page: tags become spaces but for those within a line, which vanish."""
    return "trim(" + unentitied(rf"regexp_replace(regexp_replace({x}, '</?(b|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')") + ")"


def text_nodes(x: str) -> str:
    """The texts between tags, joined."""
    each = f"list_filter(list_transform(string_split(regexp_replace({unentitied(x)}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda t: trim(t)), lambda t: t <> '')"
    return f"array_to_string({each}, ' ')"


# content is the article if it has 200 characters, else it with the advertisement above it, else these and the title; pages have one heading, and neither tables nor images
SQL["html_title_counts"] = rf"""WITH parts AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article, regexp_extract(html, '(?s)(<div class="ad">.*?</div>)', 1) AS ad FROM pages WHERE html IS NOT NULL),
scoped AS (SELECT *, CASE WHEN length({text_nodes('article')}) >= 200 THEN article WHEN length({text_nodes('ad || article')}) >= 200 THEN ad || article ELSE title || ' ' || ad || article END AS scope FROM parts),
texts AS (SELECT *, {unescaped("regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1)")} AS h1, regexp_extract_all({unescaped("scope")}, '[\p{{L}}\p{{N}}]+') AS words FROM scoped)
SELECT page_id, {unescaped("title")} AS title, '# ' || regexp_replace(h1, '([\\&<`\[>~#=+|*_-])', '\\\1', 'g') AS headings, 0 AS tables, 0 AS images, len(words)::INT AS n_words, md5(array_to_string(words, ' ')) AS words FROM texts"""

# --- PDF text ---

LIGATED = "'T' || chr(10) || 'HE ' || translate(text, 'dgk', 'ﬁﬀﬃ')"
SQL["ligatures_dropcaps"] = rf"SELECT doc_id, md5(regexp_replace(replace(replace(replace({LIGATED}, 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), '(?m)^([A-Z])\n([A-Z])', '\1\2', 'g')) AS text FROM documents"
PAGES = "pages_ AS (SELECT conv_id AS doc, turn AS page, ' Running head of ' || conv_id || ' ' || chr(10) || role || chr(10) || text AS text FROM conversations)"
REPEATED = f"""{PAGES}, lines_ AS (SELECT DISTINCT doc, page, unnest(string_split({strip('text')}, chr(10))) AS raw FROM pages_),
seen AS (SELECT doc, {strip('raw')} AS line, count(*) AS n FROM lines_ GROUP BY ALL),
gone AS (SELECT doc, line FROM seen JOIN (SELECT doc, count(*) AS pages FROM pages_ GROUP BY doc) USING (doc) WHERE line <> '' AND length(line) < 80 AND n >= greatest(2, pages // 2))"""
SQL["repeated_lines"] = f"WITH {REPEATED} SELECT doc, line FROM gone"
SQL["lines_stripped"] = f"""WITH {REPEATED}, each AS (SELECT doc, page, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS raw FROM pages_)
SELECT p.doc, p.page, md5(coalesce(string_agg(raw, chr(10) ORDER BY k), '')) AS text FROM pages_ p
LEFT JOIN (SELECT * FROM each e WHERE NOT EXISTS (FROM gone g WHERE g.doc = e.doc AND g.line = {strip('e.raw')})) e ON e.doc = p.doc AND e.page = p.page GROUP BY ALL"""
NUMBERED, NAMED = r"\d+(?:\.\d+)*\.?\s+[A-Z].+", "(?:Abstract|Acknowledge?ments?|Appendix|Appendixes|Background|Conclusions?|Copyright Notice|Introduction|References|Status of This Memo)"


def plain_headings(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda l: regexp_full_match({strip('l')}, '{NUMBERED}') OR regexp_full_match({strip('l')}, '{NAMED}')))"


PLAIN = "'1 Alpha' || chr(10) || 'Abstract' || chr(10) || '2.1 Beta' || chr(10) || text"
SQL["pdf_text_rules"] = rf"""SELECT doc_id, md5(CASE WHEN contains(text, '```') THEN '```md' || chr(10) || text || chr(10) || '```' ELSE text END) AS inner, {plain_headings(PLAIN)}::INT AS headings,
  CASE WHEN text = '' THEN true ELSE (len(regexp_extract_all(text, '\bCol\d+\b')) >= 2 AND lines >= 4) OR longest >= 1500 OR (m > 2 * p AND lines >= 4)
    OR (len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+.+$')) = 0 AND {plain_headings(PLAIN)} >= 3 AND m <= 1.25 * p) END AS prefer_plain
FROM (SELECT *, len(regexp_extract_all(text, '(?m)^\|.*\|$')) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS longest, {estimate('text')} AS m, {estimate(PLAIN)} AS p FROM documents)"""

# --- chunks ---

SPLIT = rf"""{NOTES}, marked AS (SELECT doc_id, full_path, regexp_replace(regexp_replace(content, '(?m)^(#{{1,6}}\s)', chr(1) || '\1', 'g'), '(?m)^([^\x01\n]+\n[=-]{{2,}}\s*)$', chr(1) || '\1', 'g') AS content FROM notes),
cutup AS (SELECT doc_id, full_path, unnest(range(len(l))) AS k, unnest(l) AS piece FROM (SELECT doc_id, full_path, list_filter(list_transform(string_split(content, chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM marked)),
flags AS (SELECT *, NOT contains(piece, chr(10)) AND regexp_matches(piece, '^#{{1,6}}\s') AS bare FROM cutup),
runs AS (SELECT *, sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM flags),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(run, 0) ORDER BY k) AS r FROM runs),
grouped AS (SELECT *, sum(r % 2) OVER (PARTITION BY doc_id ORDER BY k) AS g, count(*) OVER (PARTITION BY doc_id) AS pieces FROM numbered),
merged AS (SELECT doc_id, full_path, g, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS part, count(*) = 1 AND bool_and(bare) AS bare, max(g) OVER (PARTITION BY doc_id) AS last FROM grouped GROUP BY doc_id, full_path, g),
parts AS (SELECT doc_id, full_path, CASE WHEN bare AND g = last AND last > 1 THEN g - 1 ELSE g END - 1 AS pos, string_agg(part, chr(10) || chr(10) ORDER BY g) AS part FROM merged GROUP BY ALL)"""
SQL["chunk_headings_split"] = f"WITH {SPLIT} SELECT doc_id, pos::INT AS pos, md5(part) AS part, length(part)::INT AS length FROM parts"
MAY_END = r"(len(regexp_extract_all({x}, '(?m)^\s*`{{3,}}')) % 2 = 0 AND NOT (NOT contains({x}, chr(10)) AND regexp_matches({x}, '^#{{1,6}}\s')))"
NAMED_SECTION = r"(?i)(?:Abstract|Acknowledge?ments?|Appendix|Appendix\s+[A-Z0-9]+|Background|Conclusions?|Contents|Copyright Notice|Foreword|Introduction|Preface|References|Status of This Memo|Table of Contents)"
PART_SECTION = r"(?i)(?:Act|Appendix|Book|Chapter|Part|Scene)\b(?:\s+[A-Z0-9.-]+)*(?:\s*[:.-]\s*.+)?"
CAPITALS = "[A-Z][A-Z0-9 \"''&(),/:;-]{2,80}"


def begins(p: str) -> str:
    first = f"list_filter(list_transform(string_split({p}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1]"
    return rf"""coalesce((SELECT starts_with(f, '#') OR (len(regexp_extract_all(f, '\S+')) <= 18 AND (regexp_full_match(f, '\d+(?:\.\d+)*\.?\s+[A-Z].{{0,120}}') OR regexp_full_match(f, '{NAMED_SECTION}') OR regexp_full_match(f, '{PART_SECTION}') OR (NOT contains({p}, chr(10)) AND regexp_full_match(f, '{CAPITALS}')))) FROM (SELECT {first} AS f)), false)"""


def packed(source: str, key: str, size: str, sections: str = "false") -> str:
    """CTEs that pack the paragraphs of source (key, content) greedily; packs (key, chunk, text)."""
    flush = f"(w.used + p.n > {size} OR ({sections} AND w.used >= greatest(1, floor({size} * 0.6)) AND p.begins)) AND {MAY_END.format(x='w.text')}"
    return f"""paras AS (SELECT {key}, k, p, {estimate('p')} AS n, {begins('p') if sections != 'false' else 'false'} AS begins FROM (SELECT {key}, unnest(range(len(l))) AS k, unnest(l) AS p FROM (SELECT {key}, string_split(content, chr(10) || chr(10)) AS l FROM {source}))),
walk AS (SELECT {key}, k, 0 AS chunk, n AS used, p AS text FROM paras WHERE k = 0
  UNION ALL SELECT w.{key}, p.k, CASE WHEN {flush} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN {flush} THEN p.n ELSE w.used + p.n END, CASE WHEN {flush} THEN p.p ELSE w.text || chr(10) || chr(10) || p.p END
  FROM walk w JOIN paras p ON p.{key} = w.{key} AND p.k = w.k + 1),
packs AS (SELECT {key}, chunk, arg_max(text, k) AS text FROM walk GROUP BY ALL)"""


SQL["chunk_tokens_packed"] = f"WITH RECURSIVE {NOTES}, {packed('notes', 'doc_id', '120')} SELECT doc_id, chunk::INT AS pos, md5(text) AS part, {estimate('text')}::INT AS tokens FROM packs"
CHUNKS = f"""{SPLIT}, keyed AS (SELECT doc_id || '/' || pos AS id, part AS content, {estimate('part')} AS n FROM parts), large AS (SELECT * FROM keyed WHERE n > 500), {packed('large', 'id', '500')},
everything AS (SELECT id, 0 AS chunk, content FROM keyed WHERE n <= 500 UNION ALL SELECT id, chunk, text FROM packs),
chunks AS (SELECT p.doc_id, p.full_path, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos, e.chunk) AS chunk_index, count(*) OVER (PARTITION BY p.doc_id) AS chunk_count, e.content,
  {estimate('e.content')} AS tokens_estimate, 'Note ' || p.doc_id AS title FROM everything e JOIN parts p ON e.id = p.doc_id || '/' || p.pos)"""
SQL["chunk_dispatch"] = f"WITH RECURSIVE {CHUNKS} SELECT full_path, chunk_index::INT AS chunk_index, md5(content) AS content, tokens_estimate::INT AS tokens_estimate FROM chunks"
STRUCTURED = "flat AS (SELECT doc_id, '# note' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || 'INTRODUCTION AND AIMS' || chr(10) || chr(10)) AS content FROM documents)"
SQL["chunk_structured"] = f"""WITH RECURSIVE {STRUCTURED}, clean AS (SELECT doc_id, {strip('content')} AS content FROM flat), large AS (SELECT * FROM clean WHERE {estimate('content')} > 60), {packed('large', 'doc_id', '120', 'true')}
SELECT doc_id, chunk::INT AS pos, md5(text) AS part FROM packs UNION ALL SELECT doc_id, 0, md5(content) FROM clean WHERE {estimate('content')} <= 60"""


def path(k: str) -> str:
    return f"'docs/chunks/note_' || doc_id || '_' || lpad(({k})::VARCHAR, greatest(3, length(({k})::VARCHAR))::INT, '0') || '.md'"


SQL["chunk_navigation"] = f"""WITH RECURSIVE {CHUNKS} SELECT {path('chunk_index')} AS path, chunk_index::INT AS chunk_index, chunk_count::INT AS chunk_count,
  lag({path('chunk_index')}) OVER w AS previous, lead({path('chunk_index')}) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""
FIRST = f"list_filter(list_transform(string_split(content, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
HEAD = rf"""CASE WHEN regexp_matches(content, '(?m)^#{{1,6}}\s+(.+)$') THEN {strip(r"regexp_extract(content, '(?m)^#{1,6}\s+(.+)$', 1)")}
  WHEN regexp_matches(content, '(?m)^(.+)\n([=-]{{2,}})\s*$') THEN {strip(r"regexp_extract(content, '(?m)^(.+)\n([=-]{2,})\s*$', 1)")} ELSE coalesce({FIRST}[1][1:80], title) END"""
SHOWN = f"shown AS (SELECT *, {path('chunk_index')} AS path, {low_signal('content')} AS low_signal, coalesce(list_filter({FIRST}, lambda x: NOT starts_with(x, '#'))[1], heading)[1:160] AS preview FROM (SELECT *, {HEAD} AS heading FROM chunks))"
SQL["chunk_heading_preview"] = f"WITH RECURSIVE {CHUNKS}, {SHOWN} SELECT path, heading, preview, low_signal FROM shown"
SQL["document_nodes"] = f"WITH RECURSIVE {CHUNKS}, {SHOWN} SELECT path, 'chunk' AS kind, title, heading FROM shown UNION ALL SELECT full_path, 'document', 'Note ' || doc_id, NULL FROM notes"
SQL["document_keywords_weighted"] = f"""WITH RECURSIVE {CHUNKS}, {SHOWN}, good AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM shown WHERE NOT low_signal),
words AS (SELECT full_path, unnest({tokens("'Note ' || doc_id")}) AS term, 6 AS w FROM notes
  UNION ALL SELECT full_path, unnest({tokens(f"array_to_string(list_transform(({headings('content')})[:4], lambda h: {plain_heading('h')}), chr(10))")}), 4 FROM notes
  UNION ALL SELECT full_path, unnest({tokens('content[1:1500]')}), 1 FROM notes
  UNION ALL SELECT full_path, unnest({tokens('heading')}), 3 FROM good WHERE k <= 6 UNION ALL SELECT full_path, unnest({tokens('preview')}), 2 FROM good WHERE k <= 6),
ranked AS (SELECT full_path, term, row_number() OVER (PARTITION BY full_path ORDER BY sum(w) DESC, term) AS r FROM words GROUP BY full_path, term)
SELECT full_path, string_agg(term, '|' ORDER BY r) AS keywords FROM ranked WHERE r <= 8 GROUP BY full_path"""

# --- lexical ---


def lexical(nodes: str) -> str:
    """CTEs over nodes (key, body): tf, df, w (weight), norms, top (salient terms), scored pairs and edges."""
    return f"""nodes AS ({nodes}), tf AS (SELECT key, term, count(*) AS n FROM (SELECT key, unnest({tokens('body')}) AS term FROM nodes) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT *, n * idf AS weight FROM (SELECT key, term, n, ln(((SELECT count(*) FROM nodes) + 1) / (df + 1)) + 1 AS idf FROM tf JOIN df USING (term))),
norms AS (SELECT key, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY key),
top AS (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY weight DESC, term) AS rank FROM w QUALIFY rank <= 12),
pairs AS (SELECT DISTINCT a.key AS src, b.key AS dst FROM top a JOIN top b USING (term) WHERE a.key <> b.key),
dots AS (SELECT src, dst, sum(a.weight * b.weight) AS dot FROM pairs JOIN w a ON a.key = src JOIN w b ON b.key = dst AND b.term = a.term GROUP BY ALL),
lex AS (SELECT src, dst, round(raw, 3) AS score FROM (SELECT src, dst, dot / (a.norm * b.norm) AS raw FROM dots JOIN norms a ON a.key = src JOIN norms b ON b.key = dst) WHERE raw >= 0.06
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(raw, 3) DESC, dst) <= 3),
lex_terms AS (SELECT src, dst, list(term ORDER BY m DESC, term)[:4] AS terms FROM (SELECT src, dst, a.term, least(a.weight, b.weight) AS m FROM lex JOIN w a ON a.key = src JOIN w b ON b.key = dst AND b.term = a.term) GROUP BY ALL)"""


LEX = lexical("SELECT doc_id AS key, text AS body FROM documents")
SQL["term_frequency"] = f"WITH {LEX} SELECT key, term, n FROM tf"
SQL["document_frequency"] = f"WITH {LEX} SELECT term, df FROM df"
SQL["idf_weights_norms"] = f"WITH {LEX} SELECT key, round(sum(weight), 6) AS weight, round(max(idf), 6) AS idf, round(sqrt(sum(weight * weight)), 6) AS norm FROM w GROUP BY key"
SQL["salient_terms_top12"] = f"WITH {LEX} SELECT key, term, rank::INT AS rank FROM top"
SQL["lexical_candidates"] = f"WITH {LEX} SELECT src, count(*) AS candidates, sum(dst)::BIGINT AS dst_sum FROM pairs GROUP BY src"
SQL["lexical_edges_top3"] = f"WITH {LEX} SELECT src, dst, score FROM lex"
SQL["lexical_shared_terms"] = f"WITH {LEX} SELECT src, dst, array_to_string(terms, '|') AS shared_terms FROM lex_terms"

# --- references: RE2 has no look-around, so matches take the characters beside them along ---


def found_ids(x: str) -> str:
    return rf"list_filter(regexp_extract_all(upper({x}), '\b([A-Z][A-Z0-9]{{1,15}}-[0-9]{{1,5}})\b', 1), lambda i: length(regexp_extract(i, '^(.*)-', 1)) >= 3)"


IDS = found_ids("content")
SECTIONS = r"regexp_extract_all(content, '(?i)\b(?:section|sec\.?)\s+([0-9]+(?:\.[0-9]+)*)\b', 1)"
TICKS = f"list_transform(regexp_extract_all(content, '`([^`\\n]{{2,120}})`', 1), lambda b: {strip('b')})"


def normal_symbol(x: str) -> str:
    return f"lower(replace(regexp_replace({strip(x)}, '[()]+$', ''), '`', ''))"


def symbol_like(x: str) -> str:
    n = normal_symbol(x)
    return rf"""({n} <> '' AND NOT list_contains({GENERIC_S}, {n}) AND NOT regexp_full_match(upper({n}), '{ROMAN}')
      AND CASE WHEN contains({n}, '.') THEN NOT regexp_full_match({n}, '\p{{L}}(\.\p{{L}})*') AND regexp_matches({n}, '\p{{Ll}}') ELSE contains({n}, '_') OR regexp_full_match({x}, '(?:[A-Z][a-z0-9]+){{2,}}') END)"""


def joined(values: str, alias: str, limit: int | None = None) -> str:
    inner = unnested(values, "v0", "notes", "doc_id")
    return f"WITH {NOTES} SELECT n.doc_id, coalesce(v, '') AS {alias} FROM notes n LEFT JOIN ({firsts(f"SELECT * FROM ({inner}) WHERE v0 <> ''", 'doc_id', 'v0', limit)}) k ON n.doc_id = k.doc_id"


SQL["identifiers"] = joined(IDS, "identifiers")
SQL["sections"] = joined(SECTIONS, "sections")
SQL["backticks"] = joined(TICKS, "phrases")
# words of one case or another stand between non-word characters that neighbours may share, so words are taken whole and tested
WORDS = r"list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda s: length(s) >= 3 AND (regexp_full_match(s, '[A-Z][A-Za-z0-9]+') OR regexp_full_match(s, '[a-z_][a-z0-9_]{2,}') OR regexp_full_match(s, '[A-Za-z_][A-Za-z0-9_]*')))"
SYMBOLS = f"list_filter(list_concat(list_filter({TICKS}, lambda b: NOT contains(b, ' ')), {WORDS}), lambda s: {symbol_like('s')})"
SQL["symbols_limited"] = joined(SYMBOLS, "symbols", 24)

REFS = rf"""{NOTES}, ticks AS (SELECT full_path, unnest({TICKS}) AS v FROM notes),
is_path AS (SELECT *, regexp_full_match(v, '(?i)(?:\.{{0,2}}/)?(?:[\p{{L}}\p{{N}}_.-]+/)*[\p{{L}}\p{{N}}_.-]+\.(?:{SUFFIXES})') AS p, regexp_full_match(upper(v), '[A-Z][A-Z0-9]{{1,15}}-[0-9]{{1,5}}') AS i FROM ticks),
asked AS (SELECT DISTINCT full_path AS src, kind, value FROM (
  SELECT full_path, 'path' AS kind, unnest(regexp_extract_all(content, '(?i)(?:^|[^\p{{L}}\p{{N}}_])((?:\.{{0,2}}/)?(?:[\p{{L}}\p{{N}}_.-]+/)*[\p{{L}}\p{{N}}_.-]+\.(?:{SUFFIXES}))\b', 1)) AS value FROM notes
  UNION ALL SELECT full_path, 'path', v FROM is_path WHERE p
  UNION ALL SELECT full_path, 'identifier', unnest({IDS}) FROM notes
  UNION ALL SELECT full_path, 'identifier', upper(v) FROM is_path WHERE i AND NOT p
  UNION ALL SELECT full_path, 'section', unnest({SECTIONS}) FROM notes
  UNION ALL SELECT full_path, 'heading', v FROM is_path WHERE NOT p AND NOT i AND contains(v, ' ')
  UNION ALL SELECT full_path, 'symbol', v FROM is_path WHERE NOT p AND NOT i AND NOT contains(v, ' ') AND {symbol_like('v')}
  UNION ALL SELECT full_path, 'symbol', s FROM (SELECT full_path, s, row_number() OVER (PARTITION BY full_path ORDER BY k) AS n FROM (
    SELECT full_path, s, min(k) AS k FROM (SELECT full_path, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT full_path, {SYMBOLS} AS l FROM notes)) GROUP BY full_path, s)) WHERE n <= 24))"""
SQL["reference_candidates"] = f"WITH {REFS} SELECT src, kind, value FROM asked"


def normal(kind: str, value: str) -> str:
    return f"""CASE {kind} WHEN 'path' THEN lower(regexp_replace({strip(value)}, '^[./]+', '')) WHEN 'identifier' THEN upper({value})
      WHEN 'heading' THEN trim(regexp_replace(lower({value}), '[^a-z0-9]+', ' ', 'g')) WHEN 'symbol' THEN {normal_symbol(value)} ELSE {value} END"""


TITLED = f"list_concat(['Note ' || doc_id], list_transform({headings('content')}, lambda h: {plain_heading('h')}))"
INDEX = rf"""{REFS}, names AS (SELECT full_path, doc_id, original_source, content, {TITLED} AS heads FROM notes),
target_symbols AS (SELECT full_path, s, row_number() OVER (PARTITION BY full_path ORDER BY k) AS n FROM (SELECT full_path, s, min(k) AS k FROM (
  SELECT full_path, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT full_path, list_filter(list_concat(list_filter({TICKS.replace('content', 'named')}, lambda b: NOT contains(b, ' ')), {WORDS.replace('content', 'named')}), lambda s: {symbol_like('s')}) AS l
    FROM (SELECT full_path, array_to_string(heads, chr(10)) AS named FROM names))) GROUP BY full_path, s)),
index_ AS (SELECT DISTINCT kind, {normal('kind', 'value')} AS norm, full_path AS target FROM (
  SELECT full_path, 'path' AS kind, unnest([original_source, full_path, split_part(full_path, '/', 3)]) AS value FROM names
  UNION ALL SELECT full_path, 'identifier', unnest({found_ids("array_to_string(heads, chr(10)) || chr(10) || content")}) FROM names
  UNION ALL SELECT full_path, 'section', v FROM (SELECT full_path, regexp_extract(unnest(heads[2:]), '^\s*([0-9]+(?:\.[0-9]+)*)\b', 1) AS v FROM names) WHERE v <> ''
  UNION ALL SELECT full_path, 'heading', unnest(heads) FROM names
  UNION ALL SELECT full_path, 'symbol', s FROM target_symbols WHERE n <= 16) WHERE {normal('kind', 'value')} <> '')"""
SQL["reference_index"] = f"WITH {INDEX} SELECT kind, norm, target FROM index_"
MATCHES = f"""{INDEX}, counted AS (SELECT *, count(*) OVER (PARTITION BY kind, norm) AS targets FROM index_),
met AS (SELECT src, target AS dst, a.kind, value, CASE a.kind WHEN 'path' THEN 1.0 WHEN 'identifier' THEN 0.95 WHEN 'section' THEN 0.9 WHEN 'heading' THEN 0.84 ELSE 0.78 END::DOUBLE AS score
  FROM asked a JOIN counted c ON a.kind = c.kind AND {normal('a.kind', 'a.value')} = c.norm WHERE (a.kind IN ('path', 'identifier') OR targets = 1) AND (a.kind <> 'section' OR contains(c.norm, '.')) AND target <> src),
refs AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, kind, lower(value)) AS rank FROM met QUALIFY rank <= 5)"""
SQL["reference_matches"] = f"WITH {MATCHES} SELECT src, dst, kind, value, score, rank::INT AS rank FROM refs"

# --- semantic, fusion ---

SQL["embedding_topk"] = """SELECT src, dst, score, rank::INT AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw, round(raw, 3) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1) WHERE rank <= 3"""
SQL["embedding_topk_grouped"] = SQL["embedding_topk"].replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id AND (a.label - b.label) % 10 IN (1, 9, -1, -9)")


def fake_stem(t: str) -> str:
    return f"CASE WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN {t}[:-4] WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN {t}[:-3] WHEN {t} LIKE '%s' AND length({t}) > 4 AND {t} NOT LIKE '%ss' THEN {t}[:-2] ELSE {t} END"


def hashed(source: str) -> str:
    """CTEs that embed source (key, text): buckets (key, bucket, x)."""
    return f"""stems AS (SELECT DISTINCT key, {fake_stem('t')} AS t FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {source}) WHERE length(t) >= 3),
hits AS (SELECT key, ('0x' || sha256(t)[3:4])::INT AS bucket, count(*) AS n FROM stems GROUP BY ALL), buckets AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS x FROM hits)"""


SQL["hashed_embedding"] = f"WITH texts AS (SELECT doc_id AS key, text FROM documents), {hashed('texts')} SELECT key, bucket, round(x, 6) AS x FROM buckets"
FUSED = f"""{MATCHES}, {lexical('SELECT full_path AS key, content AS body FROM notes')}, texts AS (SELECT full_path AS key, content AS text FROM notes), {hashed('texts')},
sem AS (SELECT src, dst, round(raw, 3) AS score FROM (SELECT a.key AS src, b.key AS dst, sum(a.x * b.x) AS raw FROM buckets a JOIN buckets b ON a.bucket = b.bucket AND a.key <> b.key GROUP BY ALL) WHERE raw >= 0.35
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(raw, 3) DESC, dst) <= 3),
every AS (SELECT src, dst, max(score) AS ref, NULL::DOUBLE AS lex, NULL::DOUBLE AS sem, string_agg(kind || ':' || value, '|' ORDER BY rank) AS refs FROM refs GROUP BY ALL
  UNION ALL SELECT src, dst, NULL, score, NULL, NULL FROM lex UNION ALL SELECT src, dst, NULL, NULL, score, NULL FROM sem),
both_ AS (SELECT src, dst, max(ref) AS ref_score, max(lex) AS lex_score, max(sem) AS sem_score, coalesce(max(refs), '') AS "references" FROM every GROUP BY ALL),
fused AS (SELECT b.*, coalesce(t.terms, []) AS terms, CASE WHEN (ref_score IS NOT NULL)::INT + (lex_score IS NOT NULL)::INT + (sem_score IS NOT NULL)::INT > 1 THEN 'hybrid' WHEN lex_score IS NOT NULL THEN 'lexical_similarity' WHEN sem_score IS NOT NULL THEN 'semantic_similarity' ELSE 'explicit_reference' END AS relationship_type,
  round(CASE WHEN ref_score IS NOT NULL THEN least(1, ref_score + coalesce(lex_score, 0) * 0.15 + coalesce(sem_score, 0) * 0.2)
    WHEN lex_score IS NOT NULL AND sem_score IS NOT NULL THEN least(1, greatest(lex_score, sem_score) + least(lex_score, sem_score) * 0.15) ELSE coalesce(lex_score, sem_score) END, 3) AS score,
  row_number() OVER (PARTITION BY b.src ORDER BY score DESC, b.dst) AS rank FROM both_ b LEFT JOIN lex_terms t ON t.src = b.src AND t.dst = b.dst QUALIFY rank <= 3)"""
SHOW = "src, dst, rank::INT AS rank, relationship_type, score, ref_score, lex_score, sem_score"
SQL["fused_edges"] = f"""WITH {FUSED} SELECT {SHOW}, array_to_string(terms, '|') AS shared_terms, "references" FROM fused"""
SOME_REFS = FUSED.replace("every AS (SELECT src, dst, max(score) AS ref", "few AS (SELECT * FROM refs WHERE regexp_extract(src, '([0-9]+)[.]md$', 1)::BIGINT % 4 = 0),\nevery AS (SELECT src, dst, max(score) AS ref").replace("AS refs FROM refs GROUP BY", "AS refs FROM few GROUP BY")
SQL["filtered_edges"] = f"""WITH {SOME_REFS}, kw AS (SELECT full_path, term, row_number() OVER (PARTITION BY full_path ORDER BY pos) AS k FROM (
  SELECT full_path, term, min(pos) AS pos FROM ({unnested(f"list_concat({tokens("'Note ' || doc_id")}, {tokens('content')})", 'term', 'notes', 'full_path, doc_id')}) GROUP BY full_path, term) QUALIFY k <= 8),
rare AS (SELECT term FROM kw WHERE NOT list_contains({LOW}, term) AND NOT list_contains({GENERIC_A}, term) GROUP BY term HAVING count(*) <= greatest(2, (SELECT count(*) FROM notes) // 10)),
anchors AS (SELECT f.src, f.dst, list(a.term ORDER BY a.k)[:4] AS anchors FROM fused f JOIN kw a ON a.full_path = f.src JOIN kw b ON b.full_path = f.dst AND b.term = a.term JOIN rare r ON r.term = a.term GROUP BY ALL)
SELECT {SHOW.replace('src, dst', 'f.src, f.dst')}, array_to_string(CASE WHEN sem_score IS NOT NULL AND ref_score IS NULL AND len(terms) = 0 THEN coalesce(anchors, []) ELSE terms END, '|') AS shared_terms, "references"
FROM fused f LEFT JOIN anchors a ON a.src = f.src AND a.dst = f.dst WHERE sem_score IS NULL OR ref_score IS NOT NULL OR sem_score >= 0.8 OR (sem_score >= 0.6 AND len(coalesce(anchors, [])) >= 2)"""

# --- paths, retrieval, checks ---

SQL["output_paths"] = """WITH f AS (SELECT 'a.b/note_' || doc_id AS stem, ext FROM documents, (VALUES ('md'), ('txt'), ('html')) AS v(ext) WHERE ext = 'md' OR doc_id % 3 = 0)
SELECT stem || '.' || ext AS original_source, stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN '_' || ext ELSE '' END || '.md' AS out_rel FROM f"""
SQL["corpus_missing"] = f"WITH {NOTES} SELECT DISTINCT 'note_' || doc_id || '.md' AS original_source FROM labels WHERE 'note_' || doc_id || '.md' NOT IN (SELECT original_source FROM notes)"
CHUNK_IDS = found_ids("heading || chr(10) || content")
CHUNK_SYMBOLS = f"list_filter(list_concat(list_filter({TICKS.replace('content', 'named')}, lambda b: NOT contains(b, ' ')), {WORDS.replace('content', 'named')}), lambda s: {symbol_like('s')})"
#: CTEs of the references between chunks, over shown: c_refs (src, dst, kind, value, score, rank).
CHUNK_MATCHES = rf"""good AS MATERIALIZED (SELECT s.path AS full_path, s.full_path AS grp, s.doc_id, s.chunk_index, s.heading, s.content, n.original_source FROM shown s JOIN notes n USING (doc_id) WHERE NOT s.low_signal),
{re.sub("\\b(ticks|is_path|asked)\\b", r"c_\1", REFS.replace(NOTES + ", ", "").replace("FROM notes", "FROM good")).replace("c_asked AS (", "c_asked AS MATERIALIZED (").replace("c_ticks AS (", "c_ticks AS MATERIALIZED (")},
c_symbols AS MATERIALIZED (SELECT full_path, s, row_number() OVER (PARTITION BY full_path ORDER BY k) AS n FROM (SELECT full_path, s, min(k) AS k FROM (
  SELECT full_path, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT full_path, {CHUNK_SYMBOLS} AS l FROM (SELECT full_path, heading || chr(10) || content AS named FROM good))) GROUP BY full_path, s)),
c_index AS MATERIALIZED (SELECT DISTINCT kind, {normal('kind', 'value')} AS norm, full_path AS target FROM (
  SELECT full_path, 'path' AS kind, unnest([full_path, split_part(full_path, '/', 3)]) AS value FROM good
  UNION ALL SELECT full_path, 'path', unnest([original_source, grp, split_part(grp, '/', 3)]) FROM good WHERE chunk_index = 1
  UNION ALL SELECT full_path, 'identifier', unnest({CHUNK_IDS}) FROM good
  UNION ALL SELECT full_path, 'section', v FROM (SELECT full_path, regexp_extract(heading, '^\s*([0-9]+(?:\.[0-9]+)*)\b', 1) AS v FROM good) WHERE v <> ''
  UNION ALL SELECT full_path, 'heading', heading FROM good
  UNION ALL SELECT full_path, 'symbol', s FROM c_symbols WHERE n <= 12 AND {symbol_like('s')}) WHERE {normal('kind', 'value')} <> ''),
c_counted AS (SELECT *, count(*) OVER (PARTITION BY kind, norm) AS targets FROM c_index),
c_met AS (SELECT src, target AS dst, a.kind, value, CASE a.kind WHEN 'path' THEN 1.0 WHEN 'identifier' THEN 0.95 WHEN 'section' THEN 0.9 WHEN 'heading' THEN 0.84 ELSE 0.78 END::DOUBLE AS score
  FROM c_asked a JOIN c_counted c ON a.kind = c.kind AND {normal('a.kind', 'a.value')} = c.norm JOIN good g ON g.full_path = a.src JOIN good t ON t.full_path = c.target
  WHERE (a.kind IN ('path', 'identifier') OR targets = 1) AND (a.kind <> 'section' OR contains(c.norm, '.')) AND t.grp <> g.grp),
c_refs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, kind, lower(value)) AS rank FROM c_met QUALIFY rank <= 5),
c_edges AS MATERIALIZED (SELECT src, dst, max(score) AS score, string_agg(kind || ':' || value, '|' ORDER BY rank) AS "references" FROM c_refs GROUP BY src, dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(max(score), 3) DESC, dst) <= 3)"""
SQL["bridges_top8"] = f"""WITH RECURSIVE {CHUNKS}, {SHOWN.replace("shown AS (", "shown AS MATERIALIZED (")}, {CHUNK_MATCHES},
once AS (SELECT e.*, l.heading AS left_heading, r.heading AS right_heading FROM c_edges e JOIN good l ON l.full_path = e.src JOIN good r ON r.full_path = e.dst
  QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY string_split(l.grp, '/'), l.chunk_index, score DESC, dst) = 1)
SELECT src AS left_path, left_heading, dst AS right_path, right_heading, round(score, 3) AS score, 'explicit_reference' AS relationship_type, "references" FROM once ORDER BY score DESC, src, dst LIMIT 8"""
SQL["manifest_metrics"] = f"""WITH RECURSIVE {CHUNKS}, {SHOWN.replace("shown AS (", "shown AS MATERIALIZED (")}, {MATCHES.replace(NOTES + ', ', '')}, {CHUNK_MATCHES}, sorted AS (SELECT list(tokens_estimate ORDER BY tokens_estimate) AS l FROM chunks)
SELECT (SELECT count(*) FROM notes) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT sum({estimate('content')})::BIGINT FROM notes) AS total_tokens, round((SELECT avg(tokens_estimate) FROM chunks), 1) AS avg_chunk_tokens,
  round((SELECT median(tokens_estimate) FROM chunks), 1) AS median_chunk_tokens, l[greatest(1, floor(len(l) * 0.95))::INT]::INT AS p95_chunk_tokens, l[-1]::INT AS max_chunk_tokens, 0::BIGINT AS docs_without_headings,
  (SELECT count(*) FROM notes WHERE full_path NOT IN (SELECT src FROM refs)) AS docs_without_related, (SELECT count(*) FROM shown WHERE path NOT IN (SELECT src FROM c_edges)) AS chunks_without_related FROM sorted"""
SQL["manifest_integrity"] = f"""WITH RECURSIVE {CHUNKS}, linked AS (SELECT *, {path('chunk_index')} AS path FROM chunks), all_ AS (SELECT full_path AS p FROM notes UNION ALL SELECT path FROM linked)
SELECT 'missing_document' AS error, full_path AS path, NULL::VARCHAR AS detail FROM notes WHERE full_path LIKE '%5.md'
UNION ALL SELECT 'missing_chunk', path, NULL FROM linked WHERE path LIKE '%9\\_001.md' ESCAPE '\\'
UNION ALL SELECT 'bad_previous', path, NULL FROM linked WHERE chunk_index = 2 AND full_path LIKE '%7.md'
UNION ALL SELECT 'bad_next', path, NULL FROM linked WHERE chunk_index = 1 AND chunk_count > 1 AND full_path LIKE '%3.md'
UNION ALL SELECT 'bad_target', full_path, 'docs/full/note_' || (doc_id + 5) || '.md' FROM notes WHERE 'docs/full/note_' || (doc_id + 5) || '.md' NOT IN (SELECT p FROM all_)"""


def search(texts: str, fields: dict[str, int], coverage: int, prefix: str) -> str:
    """CTEs that score texts (key, text, fields) against queries (query_id, query): {prefix}_found (query_id, key, part)."""
    bonus = " UNION ALL ".join(f"SELECT a.query_id, f.key, sum(idf) * {w} AS part FROM {prefix}_asked a JOIN (SELECT DISTINCT key, unnest({search_tokens(c)}) AS term FROM {texts}) f USING (term) GROUP BY ALL" for c, w in fields.items())
    return f"""{prefix}_tf AS (SELECT key, term, count(*) AS n FROM (SELECT key, unnest({search_tokens('text')}) AS term FROM {texts}) GROUP BY ALL),
{prefix}_len AS (SELECT key, sum(n) AS length FROM {prefix}_tf GROUP BY key), {prefix}_n AS (SELECT (SELECT count(*) FROM {texts}) AS texts, (SELECT sum(length) FROM {prefix}_len) / (SELECT count(*) FROM {texts}) AS mean),
{prefix}_idf AS (SELECT term, ln(1 + (texts - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM {prefix}_tf GROUP BY term), {prefix}_n),
{prefix}_asked AS (SELECT * FROM (SELECT DISTINCT query_id, unnest({search_tokens('query')}) AS term FROM queries) JOIN {prefix}_idf USING (term)),
{prefix}_all AS (SELECT query_id, sum(idf) AS total FROM {prefix}_asked GROUP BY ALL),
{prefix}_bm AS (SELECT query_id, key, sum(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) + {coverage} * sum(idf) / any_value(total) AS part
  FROM {prefix}_asked JOIN {prefix}_tf USING (term) JOIN {prefix}_len USING (key) JOIN {prefix}_all USING (query_id), {prefix}_n GROUP BY query_id, key),
{prefix}_found AS (SELECT query_id, key, sum(part) AS part FROM (SELECT * FROM {prefix}_bm UNION ALL {bonus}) GROUP BY ALL)"""


QUERIED = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SEARCHED = f"""{CHUNKS}, {SHOWN}, {QUERIED}, chunk_texts AS (SELECT path AS key, full_path, title, s.original_source, heading, preview, concat_ws(chr(10), title, s.original_source, heading, preview, content) AS text
  FROM shown JOIN (SELECT doc_id, original_source FROM notes) s USING (doc_id)),
{search('chunk_texts', {'title': 2, 'heading': 6, 'preview': 4, 'original_source': 3}, 3, 'c')},
chunk_scores AS (SELECT query_id, key, round(sum(part), 6) AS score FROM (SELECT * FROM c_found UNION ALL SELECT query_id, key, 6 FROM chunk_texts, queries WHERE contains(lower(heading), lower(query))) GROUP BY ALL)"""
RANK10 = "SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM {0} QUALIFY rank <= 10"
SQL["bm25_chunks"] = f"WITH RECURSIVE {SEARCHED} {RANK10.format('chunk_scores')}"
DOCUMENTED = f"""{SEARCHED}, words AS (SELECT full_path, string_agg(term, ' ' ORDER BY k) AS words FROM (SELECT full_path, term, row_number() OVER (PARTITION BY full_path ORDER BY pos) AS k FROM (
  SELECT full_path, term, min(pos) AS pos FROM ({unnested(f"list_concat({tokens("'Note ' || doc_id")}, {tokens('content')})", 'term', 'notes', 'full_path, doc_id')}) GROUP BY full_path, term) QUALIFY k <= 8) GROUP BY full_path),
doc_texts AS (SELECT key, title, original_source, words, samples, concat_ws(chr(10), title, original_source, words, samples, content) AS text FROM (
  SELECT n.full_path AS key, 'Note ' || doc_id AS title, original_source, coalesce(words, '') AS words, array_to_string(list_transform(({headings('content')})[:4], lambda h: {plain_heading('h')}), ' ') AS samples, content FROM notes n LEFT JOIN words USING (full_path))),
{search('doc_texts', {'title': 4, 'original_source': 6, 'words': 3, 'samples': 3}, 4, 'd')},
doc_scores AS (SELECT query_id, key, round(sum(part), 6) AS score FROM (SELECT * FROM d_found UNION ALL SELECT query_id, full_path, 0.2 * greatest(max(score), 0) FROM chunk_scores JOIN chunk_texts USING (key) GROUP BY ALL
  UNION ALL SELECT query_id, key, 6 FROM doc_texts, queries WHERE contains(lower(title), lower(query))) GROUP BY ALL)"""
SQL["bm25_documents"] = f"WITH RECURSIVE {DOCUMENTED} {RANK10.format('doc_scores')}"
SQL["retrieval_eval"] = f"""WITH RECURSIVE {DOCUMENTED}, doc_ranks AS (SELECT query_id, original_source, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, original_source) AS r
  FROM queries CROSS JOIN doc_texts LEFT JOIN doc_scores USING (query_id, key)),
chunk_ranks AS (SELECT query_id, heading, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, key) AS r FROM queries CROSS JOIN chunk_texts LEFT JOIN chunk_scores USING (query_id, key)),
a AS (SELECT query_id, r FROM doc_ranks WHERE original_source = 'note_' || query_id || CASE WHEN query_id % 4 = 3 THEN '.txt' ELSE '.md' END),
b AS (SELECT query_id, min(r) AS r FROM chunk_ranks WHERE contains(lower(heading), 'client_' || query_id) GROUP BY query_id)
SELECT query_id, a.r::INT AS document_rank, b.r::INT AS chunk_rank, coalesce(a.r <= CASE WHEN query_id % 2 = 0 THEN 50 ELSE 3 END AND b.r <= CASE WHEN query_id % 2 = 0 THEN 50 ELSE 3 END, false) AS passed
FROM queries LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)"""
