"""DuckDB SQL for the queries of `more`, in the expressions of `oracle`."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import speech
from ..operators.summary import BANNED_OPENINGS as QUICK
from . import oracle as o
from .oracle import CHAPTERS, compact, count, has, norm_key, q, strip, sub

#: Texts with what the documents lack.
SPOKEN = [
    "Chapter 3: The Long Road\n\nA Subtitle Of Sorts\n\nIt cost US$432,500 then, and US$5 now. crea-\ntivity went on\nand on .\n\n\n\nEnd ( here ) .",
    "CHAPTER 12 The Fall of Night begins here and goes on.",
    "",
    "con-temporary con-temporary and solv-ing, comput- ers ; A- b\r\nnext\x07 line \r\n   \n  \n last",
    "a-\nb-\nc",
    "my_book-1999_2001 | final: résumé?\nChapter 2\nNot A Title, no\n- x",
    "A Title of Mine\nA Short Second Line\na title of MINE\nbody goes on and on.",
    "summary of it\n1. one\nKey Points:\nplain line here.\nImplications follow",
]
#: id, file, must_contain, must_not_contain, must_match_line, must_not_match_line, expected
CASES = [
    ("a", "doc 1", "the", None, None, None, None),
    ("b", "doc 2", None, "zzzzqqq", None, r"[0-9]{1,4}", "pass"),
    ("c", "doc 3", "zzzzqqq", None, None, None, "known_fail"),
    ("d", "doc 4", None, None, r".+", None, "known_fail"),
    ("e", "no such file", None, None, None, None, "pass"),
    ("f", "doc 5", None, None, None, r".*[a-z].*", "pass"),
]
W = r"[^\p{L}\p{N}_]"


def twice(c: str, pattern: str, to: str) -> str:
    """A pattern that takes the signs beside a word has to go over the text again for neighbours."""
    return sub(sub(c, pattern, to), pattern, to)


def ocr_normalize(c: str) -> str:
    t = sub(sub(o.normalize_text(c), rf"{P.SPACE}+([,.;:!?])", "$1"), rf"([A-Za-z])-{P.SPACE}+([a-z])", "$1$2")
    for a, b in speech.SPLIT_WORDS:
        t = twice(t, rf"(?i)(\A|{W}){a}-{P.SPACE}*{b}(\z|{W})", f"$1{a}{b}$2")
    return compact(t)


def heading_line(t: str) -> str:
    """t: compact."""
    latin = f"list_filter(string_split({t}, ' '), lambda w: {has('w', '[A-Za-z]')})"
    capital = f"len(list_filter({latin}, lambda w: {has('w', chr(92) + 'A' + chr(92) + 'p{Lu}')}))"
    return f"({t} <> '' AND ({has(t, P.CHAPTER_LABEL)} OR ({count(t, P.TOKEN)} <= 12 AND NOT {has(t, '[,;:]' + chr(92) + 'z')} AND len({latin}) > 0 AND {capital} * 20 >= len({latin}) * 11)))"


def tts_normalize(c: str) -> str:
    ends = " || ".join(f"chr({ord(x)})" for x in speech.LINE_ENDS)
    t = f"translate({sub(c, chr(92) + 'r' + chr(92) + 'n?', chr(10))}, chr(160) || {ends}, ' ' || repeat(chr(10), {len(speech.LINE_ENDS)}))"
    lines = f"list_transform(string_split({sub(t, speech.CURRENCY, '$1$2 dollars')}, chr(10)), lambda r: {strip('r')})"
    line = f"CASE WHEN list_transform([{compact('x')}], lambda t: {heading_line('t')})[1] AND NOT {has('x', P.SENTENCE_END)} THEN x || '.' ELSE x END"
    out = f"array_to_string(list_transform({lines}, lambda x: {line}), chr(10))"
    return strip(sub(sub(out, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def nonempty(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def sql(literals: list[str]) -> dict[str, str]:
    every = f"lines AS ({o.DOC_LINES} UNION ALL SELECT * FROM (VALUES {o.values(literals, ', 1')}) v(doc_id, line_no, line))"
    rows = ", ".join(f"({-1 - k}, {' || chr(10) || '.join(q(part) for part in x.split(chr(10)))})" for k, x in enumerate(SPOKEN))
    texts = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) v(doc_id, text))"
    first = "string_split(text, chr(10))[1]"
    e = "ev AS (SELECT *, event_id AS e FROM events)"
    words = f"{e}, words AS (SELECT e // 60 AS doc_id, e % 3 + 1 AS page, e % 8 AS line, e AS ord, event_type || e AS text, (e * 37 % 500)::DOUBLE AS x0, (e * 53 % 700)::DOUBLE AS y0, (e * 37 % 500 + 30)::DOUBLE AS x1, (e * 53 % 700 + 10)::DOUBLE AS y1 FROM ev)"
    boxes = f"{words}, boxes AS (SELECT doc_id, page, ord AS idx, text, x0 - 40 AS x0, y0 - 20 AS y0, x1 + 60 AS x1, y1 + 50 AS y1 FROM words WHERE ord % 7 = 0)"
    centre = lambda pad: f"b.doc_id = w.doc_id AND b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 - {pad} AND b.x1 + {pad} AND (w.y0 + w.y1) / 2 BETWEEN b.y0 - {pad} AND b.y1 + {pad}"
    box = "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1"
    word_lines = f"{words}, ln AS (SELECT doc_id, page, line, {o.normalize_text("string_agg(text, ' ' ORDER BY x0, ord)")} AS text, {box} FROM words GROUP BY 1, 2, 3)"
    own = "WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line)"
    head = f"{has(strip('text'), P.CAPTION)} OR {has(strip('text'), rf'(?i)\Afootnote\.{P.SPACE}*[0-9]+(?:{W}|\z)')}"
    groups = f"""{word_lines}, med AS (SELECT *, median(y1 - y0) OVER (PARTITION BY doc_id, page) AS m FROM ln),
      cuts AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL THEN 0 ELSE coalesce(CAST(y0 - lag(y1) OVER w > m * 2.8::DOUBLE OR (y0 - lag(y1) OVER w > m * 0.55::DOUBLE AND abs(x0 - lag(x0) OVER w) > 600::DOUBLE * 0.22::DOUBLE) OR {head} AS INTEGER), 0) END AS cut FROM med {own})"""
    conf = "CASE WHEN e % 13 = 0 THEN -1 ELSE e % 101 END"
    tsv = f"""{e}, tsv AS (SELECT e // 60 AS doc_id, e % 3 + 1 AS page, CAST(e % 5 AS INTEGER) AS block, 1 AS par, CAST(e % 11 AS INTEGER) AS line, CAST(e AS INTEGER) AS ord, 'w' || e AS text,
      (e * 37 % 500 + 0.5::DOUBLE) / 2::DOUBLE AS x0, (e * 53 % 700) / 2::DOUBLE AS y0, (e * 37 % 500 + 0.5::DOUBLE) / 2::DOUBLE + 15 AS x1, (e * 53 % 700) / 2::DOUBLE + 5 AS y1, ({conf})::DOUBLE AS conf FROM ev WHERE e % 4 <> 0 AND {conf} >= 35)"""
    plan = f"{e}, wavs AS (SELECT user_id AS chapter, e AS ord, e * 37 % 5000 + 1 AS frames FROM ev), plan AS (SELECT *, coalesce(sum(frames + 12000) OVER (PARTITION BY chapter ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off_ FROM wavs)"
    note = f"(y0 > 800 * 0.68::DOUBLE AND {has('t', chr(92) + 'A[0-9]+(?:' + P.SPACE + '+|' + chr(92) + '.)')})"
    label = has("t", rf"(?i)\A(?:chapter|part){P.SPACE}+(?:[ivxlcdm]+|[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)(?:{W}|\z)")
    centred = f"({count('t', P.TOKEN)} <= 12 AND abs((x0 + x1) / 2 - 300) < 600 * 0.16::DOUBLE)"
    short = f"(length(t) < 70 AND x1 - x0 < 600 * 0.62::DOUBLE AND {has('left(t, 1)', chr(92) + 'p{Lu}')})"
    heading = f"t <> '' AND length(t) <= 120 AND ({label} OR (NOT {has('t', chr(92) + 'A[(' + chr(92) + '[]?[0-9]{4}')} AND NOT ends_with(t, '.') AND ({centred} OR {short})))"
    kinds = [("t = ''", "empty"), (has("t", P.PAGE_NUMBER), "page_number"), (f"{count('t', P.LETTER)} = 0 AND {has('t', P.ARTIFACT)}", "extraction_artifact"), (has("t", P.URL), "url"), (has("t", P.DOI), "doi"), (f"starts_with(t, '©') OR {has('lower(t)', P.PUBLISHER)}", "footer")]
    kinds += [("y0 < 800 * 0.075::DOUBLE", "header_candidate"), (f"y1 > 800 * 0.88::DOUBLE AND {note}", "footnote"), ("y1 > 800 * 0.88::DOUBLE", "footer_candidate"), (has("t", P.CAPTION), "figure_caption"), (note, "footnote"), (heading, "heading")]
    gaps = "len(list_filter(list_transform(range(2, len(w) + 1), lambda i: w[i].x0 - w[i - 1].x1), lambda g: g > 18))"
    clock = "e * 7 % 20000"
    size = "e * e * 4097"
    units = " ".join(f"WHEN {size} >= {1024**k} AND {size} <> 0 THEN printf('%.2f {u}', round_even({size} / {1024**k}::DOUBLE, 2))" for k, u in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))) if k) + f" WHEN {size} > 0 THEN printf('%.2f B', {size}::DOUBLE)"
    bar = "CASE WHEN e % 100 > 0 THEN CAST(round_even(least(1.0::DOUBLE, (e % 120)::DOUBLE / (e % 100)) * 28, 0) AS INTEGER) ELSE 0 END"
    spec = "list_sort(list_distinct(range(conv_id % 5 + 1, conv_id % 9 + 3) || [turn * 3, 4]))"
    title = compact("text")
    parts = nonempty("string_split(text, chr(10))")
    mine = "'A Title of Mine'"
    starters = "'a', 'an', 'as', 'at', 'by', 'for', 'from', 'if', 'in', 'it', 'its', 'on', 'once', 'the', 'these', 'this', 'to', 'we', 'when', 'while', 'with'"
    ws = "string_split(b, ' ')"
    latin = f"list_filter({ws}, lambda w: {has('w', '[A-Za-z]')})"
    upper = f"len(list_filter({latin}, lambda w: {has('w', chr(92) + 'A' + chr(92) + 'p{Lu}')}))"
    subtitle = f"list_transform([{compact('x')}], lambda b: b <> '' AND len({ws}) <= 18 AND ({has('b', P.SENTENCE_END)} OR (NOT (lower({sub(f'{ws}[1]', '[^A-Za-z]')}) IN ({starters}) AND len({ws}) > 8) AND len({latin}) > 0 AND {upper} >= 0.45::DOUBLE * len({latin}))))[1]"
    opens = f"({norm_key('x')} = 'a title of mine' OR {has('x', rf'(?i)\Achapter +[0-9]+(?:{W}|\z)')})"
    dotted = f"CASE WHEN x = '' OR {has(strip('x'), P.SENTENCE_END)} THEN x ELSE x || '.' END"
    bad = rf"(?i)\A(?:{'|'.join(QUICK)})|\A[0-9]+[.)]{P.SPACE}+|\A[a-zA-Z][\p{{L}}\p{{N}}_{P.SPACE[1:-1]}]{{0,60}}:\z"
    known = f"list_transform([lower({first})], lambda u: list_transform([{strip('u')}], lambda h: CASE WHEN h <> '' AND starts_with(lower({strip('text')}), lower(h)) THEN {strip('substr(' + strip('text') + ', length(h) + 1)')} ELSE {strip('text')} END)[1])[1]"
    present = sub(sub("text", "\\r\\n?", "\n"), speech.CONTROL, " ")
    present = strip(sub(sub(sub(present, "[ \\t]+\\n", "\n"), "\\n[ \\t]+", "\n"), "\\n{3,}", "\n\n"))
    joined = sub("replace(text, chr(160), ' ')", r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    joined = f"replace(replace({sub(joined, chr(92) + 'n{2,}', chr(1))}, chr(10), ' '), chr(1), chr(10) || chr(10))"
    file = sub(strip(sub("text", rf"[^\p{{L}}\p{{N}}_{P.SPACE[1:-1]}-]+")), f"{P.SPACE}+", "_")
    folder = compact(sub(f"coalesce(nullif({strip('text')}, ''), 'Book')", "[^A-Za-z0-9._ -]+"))
    slug = sub(compact(twice(f"translate(text, '_-', '  ')", rf"(\A|{W})[0-9]{{4}}(\z|{W})", "$1$2")), r"\A[ |]+|[ |]+\z")
    case = [f"({', '.join('NULL' if x is None else q(x) for x in c)})" for c in CASES]
    line_has = lambda c: f"len(list_filter({nonempty('string_split(text, chr(10))')}, lambda x: regexp_full_match(x, {c}))) > 0"
    holds = f"text IS NOT NULL AND (must_contain IS NULL OR contains({compact('text')}, must_contain)) AND (must_not_contain IS NULL OR NOT contains({compact('text')}, must_not_contain)) AND (must_match_line IS NULL OR {line_has('must_match_line')}) AND (must_not_match_line IS NULL OR NOT {line_has('must_not_match_line')})"
    tidy = sub("t", r"\A[ |]+|[ |]+\z")
    sane = f"length({tidy}) BETWEEN 2 AND 120 AND {count(tidy, P.LETTER)} >= 2 AND NOT {o.noise(tidy)} AND NOT {has(tidy, rf'(?i){P.B}(?:chapter|contents|preface|acknowledg|references|bibliography|index){P.B}')}"
    byline = compact(sub("t", P.BY))
    seg = nonempty(f"string_split({sub('n', rf'\n{P.SPACE}*\n', chr(1))}, chr(1))")
    at = lambda k: f"list_transform([{compact(f'coalesce(p[{k}], {q(chr(32))})')}], lambda t: {heading_line('t')})[1]"
    healed = twice("string_agg(t, chr(10) ORDER BY line_no)", r"([A-Za-z])-\n([a-z])", "$1$2")
    islands = f"""lines AS ({o.DOC_LINES}), placed AS (SELECT doc_id, (line_no - 1) // 60 AS page, line_no, line AS t, CASE WHEN line_no % 11 = 0 THEN 108 ELSE 72 END::DOUBLE AS x0, 500::DOUBLE AS x1, ((line_no - 1) % 60 + 1) * 10::DOUBLE AS y0, ((line_no - 1) % 60 + 1) * 10::DOUBLE + 9 AS y1 FROM lines),
      headed AS (SELECT *, ({heading}) OR y1 > 800 * 0.88::DOUBLE AS head, median(y1 - y0) OVER (PARTITION BY doc_id, page) AS m FROM placed),
      cuts AS (SELECT *, coalesce(CAST(y0 - lag(y1) OVER w > m * 1.45::DOUBLE OR head OR lag(head) OVER w OR (abs(x0 - lag(x0) OVER w) > 24 AND y0 - lag(y1) OVER w >= m * -0.2::DOUBLE) AS INTEGER), 0) AS cut FROM headed WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_no)),
      numbered AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no) AS BIGINT) AS paragraph FROM cuts)"""
    return {
        "str_speech_normalize": f"WITH {texts} SELECT doc_id, {strip(sub(joined, '[ ' + chr(92) + 't]+', ' '))} AS text FROM texts",
        "str_ocr_normalize": f"WITH {texts} SELECT doc_id, {ocr_normalize('text')} AS text FROM texts",
        "str_presentation": f"WITH {texts} SELECT doc_id, {present} AS text FROM texts",
        "str_drop_title": f"WITH {texts} SELECT doc_id, {strip(sub(known, speech.LEGACY_HEADING))} AS text FROM texts",
        "str_tts_normalize": f"WITH {texts} SELECT doc_id, {tts_normalize('text')} AS text FROM texts",
        "win_tts_segments": f"""WITH {texts}, norm AS (SELECT doc_id, {tts_normalize('text')} AS n FROM texts), par AS (SELECT doc_id, {seg} AS p FROM norm), hd AS (SELECT doc_id, p, {at(1)} AS h1, {at(2)} AS h2 FROM par),
          cut AS (SELECT doc_id, p, CASE WHEN h1 THEN CASE WHEN h2 THEN 2 ELSE 1 END ELSE 0 END AS k FROM hd)
          SELECT doc_id, array_to_string(list_filter(list_transform(p[1:k], lambda x: {compact('x')}) || [array_to_string(p[k + 1:], chr(10) || chr(10))], lambda x: x <> ''), ' | ') AS segments FROM cut""",
        "str_names": f"WITH {texts} SELECT doc_id, coalesce(nullif(left({file}, 80), ''), 'Untitled') AS file, coalesce(nullif({folder}, ''), 'Book') AS folder, {slug} AS title FROM texts",
        "set_range_list": f"SELECT conv_id, turn, array_to_string(r, ',') AS chapters, CASE WHEN len(r) = 1 THEN printf('chapter_%03d', r[1]) ELSE 'chapters_' || array_to_string(list_transform(r[1:6], lambda k: printf('%03d', k)), '_') || CASE WHEN len(r) > 6 THEN '_plus' ELSE '' END END AS label FROM (SELECT conv_id, turn, {spec} AS r FROM conversations)",
        "prj_display": f"WITH {e} SELECT e AS event_id, CASE WHEN {clock} >= 3600 THEN printf('%02d:', ({clock}) // 3600) ELSE '' END || printf('%02d:%02d', ({clock}) % 3600 // 60, ({clock}) % 60) AS clock, CASE {units} ELSE '0 B' END AS size, '[' || repeat('#', {bar}) || repeat('-', 28 - {bar}) || ']' AS bar FROM ev",
        "flt_ocr_line": f"WITH {every} SELECT doc_id, line_no, length(t) >= 6 AND {count('t', P.LETTER)} >= 4 AND {count('t', P.MEANINGFUL)} >= 2 AS viable FROM (SELECT doc_id, line_no, {strip('line')} AS t FROM lines)",
        "flt_heading_line": f"WITH {every} SELECT doc_id, line_no, {heading_line('t')} AS heading FROM (SELECT doc_id, line_no, {compact('line')} AS t FROM lines)",
        "prj_element_class": f"WITH {every}, placed AS (SELECT doc_id, line_no, {strip('line')} AS t, (line_no * 31 % 200 + 72)::DOUBLE AS x0, (line_no * 97 % 800)::DOUBLE AS y0, (line_no * 31 % 200 + 72 + least(length(line) * 5, 400))::DOUBLE AS x1, (line_no * 97 % 800 + 10)::DOUBLE AS y1 FROM lines) SELECT doc_id, line_no, CASE {' '.join(f'WHEN {a} THEN {q(b)}' for a, b in kinds)} ELSE 'paragraph' END AS type FROM placed",
        "prj_table_rows": f"WITH {words}, rows_ AS (SELECT doc_id, page, line, list({{'x0': x0, 'x1': x1, 'text': text}} ORDER BY x0, ord) AS w FROM words GROUP BY 1, 2, 3) SELECT doc_id, page, line, len(w) >= 4 AND {gaps} >= 2 AND len(list_filter(w, lambda x: {has('x.text', '[0-9]')})) >= 2 AS is_row FROM rows_",
        "win_reading_order": f"WITH {words}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) - 1 AS INTEGER) AS idx FROM words) SELECT ord, idx, printf('p%04d_e%04d', page, idx) AS id FROM numbered",
        "jn_orphans": f"WITH {boxes} SELECT doc_id, page, ord FROM words w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE {centre(2.0)})",
        "jn_coverage": f"""WITH {boxes}, firsts AS (SELECT w.doc_id, w.page, w.line, w.ord, min(b.idx) AS idx FROM words w LEFT JOIN boxes b ON {centre(1.0)} GROUP BY 1, 2, 3, 4),
          told AS (SELECT f.doc_id, f.page, f.line, string_agg(b.text, ' ' ORDER BY b.idx) AS t FROM (SELECT DISTINCT doc_id, page, line, idx FROM firsts) f JOIN boxes b ON b.doc_id = f.doc_id AND b.page = f.page AND b.idx = f.idx GROUP BY 1, 2, 3)
          SELECT s.doc_id, s.page, s.line, coverage, coalesce(t, '') AS covered_text FROM (SELECT doc_id, page, line, round_even(avg(CASE WHEN idx IS NULL THEN 0 ELSE 1 END), 3) AS coverage FROM firsts GROUP BY 1, 2, 3) s LEFT JOIN told USING (doc_id, page, line)""",
        "win_ocr_groups": f"WITH {groups} SELECT doc_id, page, line, CAST(sum(cut) OVER w AS BIGINT) AS paragraph FROM cuts {own}",
        "win_paragraphs": f"WITH {islands} SELECT doc_id, page, paragraph, {o.normalize_text('a')} AS text FROM (SELECT doc_id, page, paragraph, {healed} AS a FROM numbered GROUP BY 1, 2, 3)",
        "src_ocr_tsv": f"WITH {tsv} SELECT * FROM tsv",
        "agg_ocr_lines": f"WITH {tsv} SELECT doc_id, page, block || '-' || par || '-' || line AS key, string_agg(text, ' ' ORDER BY x0, ord) AS text, {box} FROM tsv GROUP BY doc_id, page, block, par, line",
        "agg_book_manifest": f"SELECT book, count(*) AS total_pages, CAST(sum(n) AS BIGINT) AS total_words, round_even(sum(n) / 150.0::DOUBLE, 2) AS estimated_minutes FROM (SELECT conv_id AS book, {count('text', P.TOKEN)} AS n FROM conversations) GROUP BY 1",
        "agg_chapter_text": f"WITH {CHAPTERS} SELECT r.book, r.chapter, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS text FROM ranges r JOIN conversations c ON c.conv_id = r.book AND c.turn + 1 BETWEEN r.start_page AND r.end_page WHERE c.text <> '' GROUP BY 1, 2",
        "aud_concat_plan": f'WITH {plan} SELECT chapter, ord, off_ AS "offset" FROM plan',
        "agg_audio_totals": f"WITH {plan} SELECT chapter, count(*) AS files, max(off_ + frames) AS frames, round_even(max(off_ + frames) / 24000::DOUBLE, 2) AS seconds FROM plan GROUP BY 1",
        "man_production": f"""WITH {e}, lasts AS (SELECT user_id AS run, event_type, e, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY e DESC) = 1),
          done AS (SELECT run, count(*) AS stages, count(*) FILTER (WHERE e % 2 = 0) AS skipped, sum((e % 100)::DOUBLE) AS elapsed_seconds, bool_and(coalesce(value < 400, false)) AS complete FROM lasts GROUP BY 1),
          made AS (SELECT user_id AS run, count(*) FILTER (WHERE e % 4 = 0) AS n_wav, count(*) FILTER (WHERE e % 4 = 1) AS n_mp3, count(*) FILTER (WHERE e % 4 = 2) AS n_txt, count(*) FILTER (WHERE e % 4 = 3) AS n_json, CAST(sum(e) AS BIGINT) AS bytes, max(CASE WHEN e % 4 = 1 THEN 'f' || lpad(CAST(e AS VARCHAR), 12, '0') || '.MP3' END) AS deliverable FROM ev GROUP BY 1)
          SELECT * FROM done LEFT JOIN made USING (run)""",
        "prj_front_text": f"WITH {texts} SELECT doc_id, concat_ws(chr(10) || chr(10), list_transform([t], lambda x: {dotted})[1], CASE WHEN doc_id % 2 <> 0 AND {norm_key('t')} <> 'a subtitle' THEN 'A Subtitle.' END, 'By Jane Doe.') AS text FROM (SELECT doc_id, {title} AS t FROM texts)",
        "map_tags": f"""WITH {texts}, t AS (SELECT doc_id, {title} AS t, doc_id % 2 = 0 AS s FROM texts), f AS (SELECT *, CASE WHEN s AND t <> '' THEN t || ': A Subtitle' ELSE t END AS whole, CASE WHEN s THEN {compact("t || '. A Subtitle.'")} ELSE t END AS said FROM t)
          SELECT doc_id, concat_ws('; ', CASE WHEN whole <> '' THEN 'album=' || whole END, 'album_artist=Unknown Author', 'artist=Unknown Author', CASE WHEN said <> '' THEN 'comment=' || said END, 'date=2020', 'genre=Audiobook', CASE WHEN s THEN 'subtitle=A Subtitle' END, CASE WHEN whole <> '' THEN 'title=' || whole END, 'track=1/1') AS tags FROM f""",
        "sum_quick_part": f"WITH {texts} SELECT doc_id, {compact(f'array_to_string(list_filter({parts}, lambda x: NOT {has("x", bad)}), chr(32))')} AS text FROM texts",
        "nar_title": f"""WITH {texts}, p AS (SELECT doc_id, list_filter({parts}, lambda x, i: i = 1 OR {norm_key('x')} <> 'a title of mine') AS p FROM texts), h AS (SELECT doc_id, CASE WHEN len(p) > 0 AND {norm_key('p[1]')} = 'a title of mine' THEN p ELSE [{mine}] || p END AS p FROM p)
          SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN (i = 1 AND {opens}) OR (i = 2 AND {subtitle}) THEN {dotted} ELSE x END), chr(10) || chr(10)) AS text FROM h""",
        "src_json": f"WITH {e} SELECT e AS event_id, CASE WHEN e % 5 = 0 OR e % 7 = 0 THEN -1 ELSE CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) END AS k FROM ev",
        "srt_natural": f"WITH {e} SELECT e AS event_id, 'part' || lpad(CAST(e % 200 AS VARCHAR), 12, '0') || '_' || lpad(CAST(e AS VARCHAR), 12, '0') || '.txt' AS key FROM ev",
        "chk_cases": f"WITH c AS (SELECT * FROM (VALUES {', '.join(case)}) v(id, file, must_contain, must_not_contain, must_match_line, must_not_match_line, expected)) SELECT id, CASE WHEN coalesce(expected, 'pass') = 'known_fail' THEN CASE WHEN {holds} THEN 'RESOLVED' ELSE 'KNOWN_FAIL' END WHEN {holds} THEN 'PASS' ELSE 'FAIL' END AS status FROM c LEFT JOIN documents ON file = 'doc ' || doc_id",
        "idn_select": f"""WITH {every}, sc AS ({o.identity_scores()}), li AS (SELECT doc_id, line_no, {compact('line')} AS t FROM lines),
          ok AS (SELECT li.doc_id, li.line_no, t, title, subtitle, author, {byline} AS own FROM li JOIN sc USING (doc_id, line_no) WHERE {sane}),
          cand AS (SELECT doc_id, line_no, 'title' AS field, t AS value, least(title, 98) AS score FROM ok WHERE title >= 55 UNION ALL SELECT doc_id, line_no, 'subtitle', t, least(subtitle, 95) FROM ok WHERE subtitle >= 50
            UNION ALL SELECT doc_id, line_no, 'author', own, least(author, 98) FROM ok WHERE author >= 62 UNION ALL SELECT doc_id, line_no, 'author', own, 90 FROM ok WHERE {has('t', P.BY)} AND {o.person(sub('own', r'\A[ |]+|[ |]+\z'))}),
          keyed AS (SELECT *, {norm_key('value')} AS key FROM cand), uniq AS (SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, field, key ORDER BY score DESC, line_no) = 1),
          best AS (SELECT * FROM uniq WHERE field <> 'subtitle' QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, line_no) = 1),
          subs AS (SELECT * FROM uniq u WHERE field = 'subtitle' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = u.doc_id AND b.key = u.key) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) = 1)
          SELECT doc_id, field, value, score FROM best UNION ALL SELECT doc_id, field, value, score FROM subs""",
    }
