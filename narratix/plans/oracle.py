"""DuckDB SQL for the queries. Expressions are built by functions named as those of the library."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.classify import SKIP

#: Texts with what the documents lack.
MARKDOWN = ["### **Summary:** A *b*\n\n- item one\n1. item two\n> quote\n---\nOverview\n<think>x\ny</think>done `c` [l](u) a_b --- z", "", "```\ncode\n```\nText: ok", "“Quote” … *#*"]
SUMMARIES = ["This paper says so.", "One.\n\nTwo.", "Title: x\n\nTwo.\n\nThree.", "", "A (Smith, 2020) b.\n\nConclusion\n\nLet me know?"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str = "") -> str:
    to = to.replace("$", "\\")
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def strip(c: str) -> str:
    return sub(c, P.STRIP)


def compact(c: str) -> str:
    return strip(sub(c, f"{P.SPACE}+", " "))


def clean_text(c: str) -> str:
    return strip(sub(sub(f"replace({c}, chr(160), ' ')", "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def normalize_text(c: str) -> str:
    return compact(f"translate({c}, '“”‘’', {q(chr(34) * 2 + chr(39) * 2)})")


def norm_key(c: str) -> str:
    return f"trim({sub(f'lower({c})', '[^a-z0-9]+', ' ')})"


def sentences(c: str) -> str:
    for a in P.ABBREVIATIONS:
        c = f"replace({c}, {q(a)}, {q(a.replace('.', P.STOP))})"
    parts = f"string_split({sub(c, P.SENTENCE, f'$1{P.CUT}$2')}, {q(P.CUT)})"
    return f"list_filter(list_transform({parts}, lambda s: {strip(f'replace(s, {q(P.STOP)}, {q(chr(46))})')}), lambda s: s <> '')"


def heading_unit(t: str) -> str:
    """t: compact."""
    return f"({t} <> '' AND ({has(t, P.CHAPTER_LABEL)} OR ({count(t, P.TOKEN)} <= 12 AND NOT {has(t, P.SENTENCE_END)})))"


def preview(c: str) -> str:
    t = compact(c)
    return f"CASE WHEN length({t}) <= 160 THEN {t} ELSE {sub(f'left({t}, 160)', P.SPACE + '+' + chr(92) + 'z')} || '...' END"


def layout_marker(c: str) -> str:
    t = normalize_text(c)
    return f"({t} <> '' AND ({has(t, P.LAYOUT_MARKER)} OR ({count(t, P.LETTER)} = 0 AND length({t}) <= 18 AND {has(t, f'{chr(92)}A{P.NUMERIC}{chr(92)}z')})))"


def speech_marker(c: str) -> str:
    t = compact(clean_text(c))
    return f"({t} <> '' AND ({has(t, P.SPEECH_MARKER)} OR ({count(t, P.LETTER)} = 0 AND length({t}) <= 24 AND {has(t, f'{chr(92)}A{P.NUMERIC}{chr(92)}z')})))"


def cleaner_marker(c: str, strict: bool = False) -> str:
    t = compact(c)
    key = sub(t, "[^0-9.]")
    free = f"NOT {has(t, '[A-Za-z]')}"
    short, section = has(key, P.SHORT_KEY), has(key, P.SECTION_KEY)
    by_key = f"{short} OR ({free} AND {section})" if strict else f"({free} AND ({short} OR {section}))"
    return f"({t} = '' OR {has(t, P.CLEAN_MARKER)} OR {by_key})"


def text_class(c: str) -> str:
    t = strip(c)
    cases = [(f"{t} = ''", "empty"), (has(t, P.PAGE_NUMBER), "page_number"), (f"{count(t, P.LETTER)} = 0 AND {has(t, P.ARTIFACT)}", "extraction_artifact"), (has(t, P.URL), "url"), (has(t, P.DOI), "doi")]
    cases += [(f"starts_with({t}, '©') OR {has(f'lower({t})', P.PUBLISHER)}", "footer"), (has(t, P.CAPTION), "figure_caption")]
    return "CASE " + " ".join(f"WHEN {a} THEN {q(b)}" for a, b in cases) + " ELSE 'paragraph' END"


def skip_reason(c: str, kind: str, strict: bool) -> str:
    skip = ", ".join(map(q, SKIP))
    return f"CASE WHEN {compact(c)} = '' THEN 'empty' WHEN {kind} IN ({skip}) THEN {kind} WHEN {cleaner_marker(c, strict)} THEN 'marker' END"


def normalize_paragraph(c: str) -> str:
    one = sub(sub(f"translate({c}, chr(160) || chr(13), ' ' || chr(10))", rf"{P.SPACE}*\n{P.SPACE}*", " "), "[ \\t]+", " ")
    return strip(sub(sub(sub(one, rf"{P.SPACE}+([,.;:!?])", "$1"), rf"([(\[{{]){P.SPACE}+", "$1"), rf"{P.SPACE}+([)\]}}])", "$1"))


def narration_paragraph(c: str) -> str:
    t = normalize_paragraph(sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))
    for broken, whole in (("com-{0}+puter", "computer"), ("comput-{0}+ers", "computers"), ("con-{0}+temporary", "contemporary")):
        t = sub(t, r"(?i)(\A|[^\p{L}\p{N}_])" + broken.format(P.SPACE), "$1" + whole)
    return strip(t)


def person(t: str) -> str:
    """t: compact and tidy."""
    own = sub(t, P.BY)
    words = f"list_filter(list_transform(string_split({own}, ' '), lambda w: {sub('w', '[^A-Za-zÀ-ÖØ-öø-ÿ' + chr(39) + '.-]')}), lambda w: w <> '')"
    small = ", ".join(map(q, P.PARTICLES))
    capital = rf"len(list_filter({words}, lambda w: lower(w) NOT IN ({small}) AND {has('w', chr(92) + 'A' + chr(92) + 'p{Lu}')}))"
    return f"({own} <> '' AND length({own}) <= 80 AND NOT {noise(own)} AND len({words}) BETWEEN 2 AND 5 AND {capital} >= 2)"


def noise(t: str) -> str:
    return f"({has(f'lower({t})', P.NOISE)} OR {has(t, P.NOISE_ONLY)})"


def identity_scores() -> str:
    t = "t"
    n = count(t, P.TOKEN)
    tidy = sub("t", r"\A[ |]+|[ |]+\z")
    words = f"regexp_extract_all(t, {q(P.LATIN_WORD)})"
    small = ", ".join(map(q, P.SMALL))
    good = rf"len(list_filter({words}, lambda w: {has('w', chr(92) + 'A' + chr(92) + 'p{Lu}')} OR lower(w) IN ({small})))"
    case = f"(len({words}) > 0 AND {good} >= 0.7 * len({words}))"
    subtitle = f"({has(tidy, '[:—–]')} OR (n BETWEEN 5 AND 14 AND NOT is_person))"
    add = lambda *x: " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in x)
    return f"""SELECT doc_id, line_no,
      CAST(50 + {add(('n BETWEEN 1 AND 7', 12), ('n > 16', -25), ('is_person', -15), ('is_case', 8), ('is_noise', -50))} AS INTEGER) AS title,
      CAST(30 + {add(('n BETWEEN 4 AND 14', 12), ('n > 16', -10), ('is_person', -10), ('is_sub', 25), ('is_case', 8), ('is_noise', -50))} AS INTEGER) AS subtitle,
      CAST(25 + {add(('n > 16', -20), ('is_person', 45), ('is_noise', -50))} AS INTEGER) AS author
    FROM (SELECT *, {subtitle} AS is_sub FROM (SELECT doc_id, line_no, t, {n} AS n, {person(tidy)} AS is_person, {case} AS is_case, {noise('t')} AS is_noise
      FROM (SELECT doc_id, line_no, {compact('line')} AS t FROM lines)))"""


def speech_line(raw: str) -> str:
    t = strip(raw)
    mark = sub(sub(t, rf"\A#{{1,6}}{P.SPACE}*"), rf"\A>{P.SPACE}*")
    mark = strip(sub(sub(mark, rf"\A[-*+•]{P.SPACE}+"), rf"\A[0-9]+[.)]{P.SPACE}+"))
    for p in (r"\*\*([^*]+)\*\*", "__([^_]+)__", r"\*([^*]+)\*", "_([^_]+)_"):
        mark = sub(mark, p, "$1")
    mark = strip(sub(strip(f"replace({mark}, '`', '')"), rf"(?i)\A(?:executive summary|quick summary|detailed summary|book review|overview|summary){P.SPACE}*[:\-–—]{P.SPACE}*"))
    mark = sub(f"replace(replace({mark}, '*', ''), '#', '')", rf"\A{P.SPACE}*[-–—]+{P.SPACE}*")
    mark = sub(sub(mark, rf"{P.SPACE}+[-–—]{{2,}}{P.SPACE}+", " "), "[-–—]{3,}", " ")
    mark = strip(sub(sub(strip(mark), rf"\A[:\-–—]+{P.SPACE}*"), rf"{P.SPACE}*[:\-–—]+\z"))
    labels = ", ".join(map(q, P.HEADING_LABELS))
    separator = has(t, r"\A[*#_=~\-.–—" + P.SPACE[1:-1] + r"]{3,}\z")
    return f"CASE WHEN {t} = '' OR {separator} THEN '' ELSE list_transform([{mark}], lambda m: CASE WHEN {compact(sub('lower(m)', '[^a-z0-9 ]+'))} IN ({labels}) THEN '' ELSE m END)[1] END"


def clean_for_speech(c: str) -> str:
    t = sub(c, "\\r\\n?", "\n")
    t = f"replace(translate({t}, chr(160) || '“”‘’' || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' {chr(34)}{chr(34)}{chr(39) * 4}'), '…', '...')"
    t = sub(sub(t, "(?is)<think>.*?</think>"), "(?s)```.*?```")
    t = sub(sub(t, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda r: {speech_line('r')}), chr(10))"
    out = sub(sub(sub(out, "[*#`_•]"), "[-–—]{3,}", " "), "[ \\t]+", " ")
    return strip(sub(sub(out, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def n_errors(c: str) -> str:
    t = strip(c)
    body = sub("t", rf"(?s)\AThis is a quick overview of .*? by .*?\.{P.SPACE}*")
    full = lambda x, by: f"list_filter(list_transform(string_split({x}, {by}), lambda s: {strip('s')}), lambda s: s <> '')"
    n = f"len({full(body, 'chr(10) || chr(10)')})"
    head = f"len(list_filter({full('t', 'chr(10)')}, lambda s: length(s) <= 80 AND NOT ends_with(s, '.') AND NOT ends_with(s, '?') AND NOT starts_with(s, 'This is a quick overview'))) > 0"
    parts = [f"{n} NOT BETWEEN 2 AND 4", *(has("t", p) for p in P.BANNED), head]
    return f"list_transform([{t}], lambda t: CASE WHEN t = '' THEN 1 ELSE {' + '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END' for x in parts)} END)[1]"


def values(texts: list[str], columns: str = "") -> str:
    return ", ".join(f"({-1 - k}{columns}, {q(x)})" for k, x in enumerate(texts))


DOC_LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


CHAPTERS = """toc AS (SELECT conv_id AS book, turn AS idx, turn + 1 AS page FROM conversations WHERE role = 'user'),
      totals AS (SELECT conv_id AS book, max(turn) + 1 AS total_pages FROM conversations GROUP BY 1),
      ranges AS (SELECT book, CAST(row_number() OVER w AS INTEGER) AS chapter, page AS start_page, coalesce(lead(page) OVER w - 1, total_pages) AS end_page FROM toc JOIN totals USING (book) WHERE page <> 0 WINDOW w AS (PARTITION BY book ORDER BY idx)
        UNION ALL SELECT book, 1, 1, total_pages FROM totals WHERE book NOT IN (SELECT book FROM toc))"""


def sql(literals: list[str]) -> dict[str, str]:
    every = f"lines AS ({DOC_LINES} UNION ALL SELECT * FROM (VALUES {values(literals, ', 1')}) v(doc_id, line_no, line))"
    docs = f"lines AS ({DOC_LINES})"
    kinds = f"kinds AS (SELECT doc_id, line_no, line, {text_class('line')} AS kind FROM lines)"
    spoken = f"CASE WHEN kind = 'figure_caption' THEN CASE WHEN {has('p', chr(92) + 'A(?i)(?:figure|fig' + chr(92) + '.)' + P.SPACE + '+[0-9]')} THEN p ELSE {strip(q('Figure caption. ') + ' || p')} END ELSE p END"
    blocks = f"{docs}, {kinds}, said AS (SELECT doc_id, line_no, {spoken} AS block FROM (SELECT *, {narration_paragraph('line')} AS p FROM kinds WHERE {skip_reason('line', 'kind', False)} IS NULL))"
    fold = f"""{blocks}, compacted AS (SELECT doc_id, line_no, {compact('block')} AS b FROM said WHERE block <> ''),
      parts AS (SELECT doc_id, line_no, heading, CASE WHEN heading THEN [b] ELSE {sentences('b')} END AS s, b FROM (SELECT *, {heading_unit('b')} AS heading FROM compacted) WHERE b <> ''),
      flat AS (SELECT doc_id, line_no, heading, generate_subscripts(s2, 1) AS k, unnest(s2) AS unit FROM (SELECT doc_id, line_no, heading, CASE WHEN len(s) = 0 THEN [b] ELSE s END AS s2 FROM parts)),
      units AS (SELECT doc_id, unit, heading, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) AS i, {count('unit', P.WORD)} AS w FROM flat),
      fold AS (SELECT doc_id, i, w AS cur, 1 AS bin FROM units WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN (f.cur >= 50 AND f.cur + u.w > 85) OR f.cur + u.w > 110 THEN u.w ELSE f.cur + u.w END, CASE WHEN (f.cur >= 50 AND f.cur + u.w > 85) OR f.cur + u.w > 110 THEN f.bin + 1 ELSE f.bin END
        FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
      raw AS (SELECT f.doc_id, f.bin, sum(u.w) AS words, count(*) AS n FROM fold f JOIN units u USING (doc_id, i) GROUP BY 1, 2),
      tail AS (SELECT doc_id, max(bin) AS last FROM raw GROUP BY 1),
      merging AS (SELECT t.doc_id, t.last FROM tail t JOIN raw a ON a.doc_id = t.doc_id AND a.bin = t.last JOIN raw b ON b.doc_id = t.doc_id AND b.bin = t.last - 1 WHERE a.words < 50 AND a.words + b.words <= 135),
      chunks AS (SELECT r.doc_id, CAST(CASE WHEN m.last = r.bin THEN r.bin - 1 ELSE r.bin END AS INTEGER) AS ord, CAST(sum(words) AS INTEGER) AS words, CAST(sum(n) AS INTEGER) AS n_units FROM raw r LEFT JOIN merging m ON m.doc_id = r.doc_id GROUP BY 1, 2),
      timed AS (SELECT *, CAST(greatest(1, round_even(words / 160.0 * 60.0, 0)) AS INTEGER) AS estimated_seconds FROM chunks)"""
    # headings stand alone, and so does what a merged tail brings
    chunk_texts = """heads AS (SELECT f.doc_id, f.bin, f.i, u.unit, u.heading OR coalesce(lag(u.heading) OVER w, true) AS apart, row_number() OVER w AS k FROM fold f JOIN units u USING (doc_id, i) WINDOW w AS (PARTITION BY f.doc_id, f.bin ORDER BY f.i)),
      placed AS (SELECT h.doc_id, CAST(CASE WHEN m.last = h.bin THEN h.bin - 1 ELSE h.bin END AS INTEGER) AS ord, i, CASE WHEN k = 1 AND m.last IS DISTINCT FROM h.bin THEN '' WHEN apart THEN chr(10) || chr(10) ELSE ' ' END || unit AS piece FROM heads h LEFT JOIN merging m ON m.doc_id = h.doc_id),
      texts AS (SELECT doc_id, ord, string_agg(piece, '' ORDER BY i) AS text FROM placed GROUP BY 1, 2)"""
    spaced = compact("text")
    return {
        "str_clean_text": f"SELECT doc_id, {clean_text('text')} AS text_clean FROM documents",
        "str_norm_key": f"SELECT doc_id, {norm_key('text')} AS norm_key FROM documents",
        "str_sentence_split": f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, array_to_string(s, ' | ') AS sentences FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "str_word_counts": "SELECT doc_id, " + ", ".join(f"CAST({count('text', p)} AS INTEGER) AS {n}" for n, p in (("n_words", P.WORD), ("n_tokens", P.TOKEN), ("n_meaningful", P.MEANINGFUL), ("n_letters", P.LETTER))) + " FROM documents",
        "str_preview": f"SELECT doc_id, {preview('text')} AS preview FROM documents",
        "flt_markers": f"WITH {every} SELECT doc_id, line_no, {layout_marker('line')} AS layout, {speech_marker('line')} AS speech, {cleaner_marker('line')} AS cleaner, {cleaner_marker('line')} AS narration, {cleaner_marker('line', True)} AS strict FROM lines",
        "flt_heading_unit": f"WITH {every} SELECT doc_id, line_no, CASE WHEN {heading_unit('t')} THEN 'heading' ELSE 'body' END AS kind FROM (SELECT doc_id, line_no, {compact('line')} AS t FROM lines)",
        "prj_classify_text": f"WITH {every}, {kinds} SELECT kind AS class, count(*) AS n FROM kinds GROUP BY 1",
        "prj_front_matter": f"WITH {every} SELECT doc_id, line_no, concat_ws(',', " + ", ".join(f"CASE WHEN {has('lower(line)', p)} THEN {q(n)} END" for n, p in (("copyright", "copyright|isbn"), ("table_of_contents", "contents"), ("acknowledgements", "acknowledg"), ("preface", "preface"), ("foreword", "foreword"))) + ") AS labels FROM lines",
        "prj_identity_score": f"WITH {every} {identity_scores()}",
        "nar_render": f"WITH {blocks} SELECT d.doc_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE block <> ''), '') AS narration FROM documents d LEFT JOIN said USING (doc_id) GROUP BY 1",
        "chk_chunks": f"WITH RECURSIVE {fold}, {chunk_texts} SELECT doc_id, ord, words, n_units, estimated_seconds, text FROM timed JOIN texts USING (doc_id, ord)",
        "chk_manifest": f"WITH RECURSIVE {fold} SELECT doc_id, count(*) AS chunks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(estimated_seconds) AS BIGINT) AS estimated_seconds, round_even(sum(estimated_seconds) / 60.0, 2) AS estimated_minutes FROM timed GROUP BY 1",
        "win_chapter_ranges": f"WITH {CHAPTERS} SELECT * FROM ranges",
        "jn_page_chapter": f"WITH {CHAPTERS} SELECT r.book, r.chapter, CAST(coalesce(sum({count('c.text', P.TOKEN)}), 0) AS BIGINT) AS word_count FROM ranges r LEFT JOIN conversations c ON c.conv_id = r.book AND c.turn + 1 BETWEEN r.start_page AND r.end_page GROUP BY 1, 2",
        "agg_skip_hist": f"WITH {every}, {kinds}, reasons AS (SELECT CASE WHEN doc_id < 0 THEN 'literal' ELSE 'document' END AS origin, {skip_reason('line', 'kind', True)} AS reason FROM kinds) SELECT origin, reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY ROLLUP (origin, reason)",
        "agg_type_counts": f"WITH {every}, {kinds} SELECT kind AS type, count(*) AS n, count(*) FILTER (WHERE kind NOT IN ('empty', {', '.join(map(q, SKIP))})) AS narrated FROM kinds GROUP BY 1",
        "win_dedupe_best": f"WITH {every}, keyed AS (SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS n_chars, {norm_key('line')} AS key FROM lines) SELECT key, doc_id, line_no, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id, line_no) AS n FROM keyed) WHERE n = 1",
        "jn_fallback": "SELECT doc_id, coalesce('quality ' || CAST(quality AS VARCHAR), source) AS value FROM documents LEFT JOIN labels USING (doc_id)",
        "jn_resume_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "jn_heading_suffix": f"WITH {docs}, heads AS (SELECT doc_id, line_no AS idx, line AS text FROM (SELECT *, {compact('line')} AS t FROM lines) WHERE {heading_unit('t')}), both_ AS (SELECT * FROM heads UNION ALL SELECT doc_id, idx + 1000000, regexp_replace(text, '\\A[^ ]+ ', '') FROM heads) SELECT * FROM both_ e WHERE length(text) > 6 AND EXISTS (SELECT 1 FROM both_ h WHERE h.doc_id = e.doc_id AND h.idx < e.idx AND ends_with(h.text, e.text) AND h.text <> e.text)",
        "chk_regression": f"WITH d AS (SELECT {spaced} AS t FROM documents), c AS (SELECT item_id, {spaced} AS phrase FROM benchmark), f AS (SELECT item_id, EXISTS (SELECT 1 FROM d WHERE contains(d.t, c.phrase)) AS found FROM c) SELECT item_id, CASE WHEN item_id % 5 = 0 THEN CASE WHEN found THEN 'RESOLVED' ELSE 'KNOWN_FAIL' END WHEN found THEN 'PASS' ELSE 'FAIL' END AS status FROM f",
        "sum_clean": f"SELECT doc_id, {clean_for_speech('text')} AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {values(MARKDOWN)}) v(doc_id, text))",
        "sum_validate": f"SELECT conv_id, turn, CAST({n_errors('text')} AS INTEGER) AS n_errors FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {values(SUMMARIES, ', 0')}) v(conv_id, turn, text))",
        "win_progress": "SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS current, count(*) OVER (PARTITION BY user_id) AS total, CAST(floor(row_number() OVER w * 100 / count(*) OVER (PARTITION BY user_id)) AS INTEGER) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
        "status_latest": "SELECT user_id, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_update FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
        "srt_topk": f"WITH {docs} SELECT line, count(*) AS n FROM lines GROUP BY 1 ORDER BY n DESC, line LIMIT 20",
    }
