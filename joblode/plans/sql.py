"""DuckDB expressions of the column functions, for the oracles."""

from __future__ import annotations

from joblode.functions import company as co
from joblode.functions import misc, place, skills as sk, status as st, title as ti, web


def s(x: str) -> str:
    """A text inside a SQL string."""
    return x.replace("'", "''")


def strings(values) -> str:
    return ", ".join(f"'{s(v)}'" for v in values)


def case_map(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{s(k)}' THEN '{s(v)}'" for k, v in table.items()) + " END"


def url(x: str, group: int) -> str:
    return rf"regexp_extract(trim(coalesce({x}, '')), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {group})"


def hint(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_extract(coalesce({x}, ''), '^[a-z]+://[^/]+(?:/[^?#]*)?/job/([^/?#]+)', 1), '[-_+\s]+', ' ', 'g')))"


def native_id(x: str) -> str:
    p, qs = url(x, 3), f"concat('&', {url(x, 4)})"
    tail = f"regexp_extract({p}, '([^/]+)/*$', 1)"
    keys = ", ".join(f"nullif(regexp_extract({qs}, '&{k}=([^&]+)', 1), '')" for k in ("jobId", "job_id", "id", "jobid", "postingId", "gh_jid", "job"))
    return rf"CASE WHEN {url(x, 2)} = '' THEN '' ELSE coalesce(nullif(regexp_extract({p}, '/jobs/view/(\d+)', 1), ''), {keys}, CASE WHEN regexp_matches({tail}, '^[A-Za-z0-9_-]{{4,64}}$') AND lower({tail}) NOT IN ('jobs', 'job', 'search', 'view', 'careers') THEN {tail} END, '') END"


def _named(x: str, table) -> str:
    w = f"concat(' ', {words_only(x)}, ' ')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({w}, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{name}'" for name, phrases in table) + " ELSE '' END"


def workplace(loc: str, title: str) -> str:
    return _named(f"concat_ws(' ', {loc}, {title})", place.WORKPLACES)


def employment(x: str) -> str:
    return _named(x, place.EMPLOYMENTS)


def staffing(x: str) -> str:
    w = f"concat(' ', {words_only(f'coalesce({x}, {chr(39) * 2})')}, ' ')"
    rest = f"string_split({w}, 'recruiting')[-1]"
    return "(" + " OR ".join(f"contains({w}, '{p}')" for p in co.STAFFING) + f" OR (contains({w}, 'recruiting') AND NOT contains({rest}, ' internal ') AND NOT contains({rest}, ' in house ')))"


def words_only(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def company_key(x: str) -> str:
    raw = f"trim(lower(coalesce({x}, '')))"
    words = f"list_filter(string_split({words_only(f"regexp_replace(replace({raw}, '&', ' and '), '\\([^)]*\\)', ' ', 'g')")}, ' '), lambda w: w <> '')"
    step = lambda expr, then: f"list_transform([{expr}], lambda l: {then})[1]"
    v = step(words, f"CASE WHEN ends_with({raw}, 'co.') AND l[-1] = 'co' THEN l[:-2] ELSE l END")
    v = step(v, "CASE WHEN l[-1] = 'sa' THEN l[:-2] WHEN l[-1] = 'a' AND l[-2] = 's' THEN l[:-3] ELSE l END")
    for _ in range(2):
        v = step(v, f"CASE WHEN len(l) > 1 AND l[-1] IN ({strings(co.SUFFIXES)}) THEN l[:-2] ELSE l END")
    v = f"array_to_string(list_transform({v}, lambda w: coalesce({case_map('w', co.STEMS)}, w)), ' ')"
    return f"list_transform([{v}], lambda z: coalesce({case_map('z', co.ABBREVIATIONS)}, z))[1]"


def area(x: str) -> str:
    loc = f"lower(coalesce({x}, ''))"
    words = f"substr(trim(regexp_replace({loc}, '[^a-z]+', ' ', 'g')), 1, 40)"
    code = rf"regexp_extract({loc}, ',\s*([a-z]{{2}})\b', 1)"
    return rf"CASE WHEN {code} <> '' THEN {code} WHEN regexp_matches({loc}, '\bremote\b') THEN 'remote' WHEN {words} = '' THEN 'unknown' ELSE {words} END"


def canonical_key() -> str:
    k = company_key("company")
    return f"CASE WHEN {words_only('title')} = '' THEN '' ELSE concat_ws('::', CASE WHEN {k} = '' THEN 'unknown-employer' ELSE {k} END, {words_only('title')}, {area('location')}, coalesce(strftime(posted, '%Y-%m-%d'), 'undated')) END"


def role_tokens(x: str) -> str:
    t = rf"regexp_replace(lower(coalesce({x}, '')), '\bmember\s+of\s+technical\s+staff\b', ' engineer ', 'g')"
    t = words_only(rf"regexp_replace({t}, '\b([a-z0-9]{{1,3}})/([a-z0-9]{{1,3}})\b', '\1\2', 'g')")
    return f"list_filter(string_split({t}, ' '), lambda w: (length(w) > 3 OR w IN ({strings(ti.ACRONYMS)})) AND w NOT IN ({strings(ti.STOPWORDS)}))"


def distinct_in_order(x: str) -> str:
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


def seniority_words(x: str) -> str:
    return distinct_in_order(f"list_filter(string_split({words_only(f'coalesce({x}, chr(32))')}, ' '), lambda w: w IN ({strings(ti.SENIORITY)}))")


def has(x: str, phrases) -> str:
    """Whether one of the phrases stands in the words of a title."""
    return "(" + " OR ".join(f"contains({_padded(x)}, ' {p} ')" for p in phrases) + ")"


def _padded(x: str) -> str:
    return f"concat(' ', {words_only(f'coalesce({x}, {chr(39)}{chr(39)})')}, ' ')"


def seniority(x: str) -> str:
    more = {"junior": f" AND NOT {has(x, ti.NOT_JUNIOR)}"}
    return "CASE " + " ".join(f"WHEN {has(x, phrases)}{more.get(level, '')} THEN '{level}'" for level, phrases in ti.LEVELS.items()) + " ELSE 'mid' END"


def tier(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    for written, word in ti.ONE_WORD:
        t = f"regexp_replace({t}, '{s(written)}', '{s(word.replace('$', chr(92)))}', 'g')"
    words = rf"string_split(trim(regexp_replace(regexp_replace({t}, '[^a-z0-9\s]+', ' , ', 'g'), '\s+', ' ', 'g')), ' ')"
    two = lambda i: f"concat(t[{i}], ' ', t[{i} + 1])"
    is_one = lambda i, ps: f"(t[{i}] IN ({strings(p for p in ps if ' ' not in p)}) OR {two(i)} IN ({strings(p for p in ps if ' ' in p) or chr(39) * 2}))"
    levels = " ".join(f"WHEN {is_one('i', ps)} THEN {n}" for n, ps in ti.TIERS.items())
    weight = f"greatest(CASE {levels} WHEN t[i] = 'graduate' AND list_has_any(t, ['program', 'scheme']) THEN 1 ELSE 0 END, CASE WHEN regexp_full_match(t[i], '[a-z][a-z]+') THEN coalesce({case_map('t[i + 1]', {k: str(v) for k, v in ti.NUMERALS.items()})}, '0')::INTEGER ELSE 0 END)"
    first = f"list_filter(list_transform(range(1, len(t) + 1), lambda i: {weight}), lambda n: n > 0)[1]"
    a = "list_position(t, 'associate')"
    word = lambda i: f"regexp_full_match(t[{a} + {i}], '[a-z]+')"
    office = lambda i: is_one(f"{a} + {i}", ti.OFFICES)
    near = f"({office(1)} OR ({word(1)} AND {office(2)}) OR ({word(1)} AND {word(2)} AND {office(3)}))"
    young = f"len(list_filter(t[1:{a} - 1], lambda w: w IN ({strings(ti.BEGINNERS)}))) > 0"
    program = f"len(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({strings(ti.BEGINNERS)}) AND t[i + 1] IN ({strings(ti.PROGRAMS)}))) > 0"
    heads = f"len(list_filter(range(1, len(t) + 1), lambda i: {is_one('i', ti.HEADS)})) > 0"
    named = case_map(f"CAST({first} AS VARCHAR)", {str(k): v for k, v in ti.TIER_NAMES.items()})
    return f"list_transform([{words}], lambda t: CASE WHEN coalesce({a}, 0) > 0 AND NOT {young} AND coalesce({near}, false) THEN 'senior' WHEN {program} AND {heads} THEN 'senior' ELSE coalesce({named}, 'mid') END)[1]"


def folded(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(translate(coalesce({x}, ''), '‘’ʼ′´`“”″', {chr(39)}{chr(39) * 12}\"\"\"{chr(39)}))), '\\s+', ' ', 'g'))"


def phrase(x: str, phrases, whole: bool = False) -> str:
    """Whether one of the phrases stands in x (between other than letters and digits)."""
    if not whole:
        return "(" + " OR ".join(f"contains({x}, '{s(p)}')" for p in phrases) + ")"
    return f"regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}])({s('|'.join(phrases))})([^\\p{{L}}\\p{{N}}]|$)')"


def status(x: str) -> str:
    b = rf"lower(trim(regexp_replace(trim(replace(coalesce({x}, ''), '**', '')), '\s+\d{{4}}(-\d{{2}}-\d{{2}}.*)?$', '')))"
    return rf"CASE WHEN regexp_matches({b}, '^(duplicad|dup\b|repost)') OR {b} IN ('', '-', '—') THEN 'Discarded' ELSE {case_map(b, st.ALIASES)} END"


def number(x: str) -> str:
    comma = f"length({x}) - strpos(reverse({x}), ',') > length({x}) - strpos(reverse({x}), '.')"
    both = f"CASE WHEN {comma} THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END"
    one = rf"replace(regexp_replace({x}, '[.,](\d{{3}})(\D|$)', '\1\2', 'g'), ',', '.')"
    return f"try_cast(CASE WHEN strpos({x}, ',') > 0 AND strpos({x}, '.') > 0 THEN {both} ELSE {one} END AS DOUBLE)"


def money(x: str, end: int) -> str:
    t = rf"trim(regexp_replace(regexp_replace(trim(coalesce({x}, '')), '[€$£¥]', '', 'g'), '\s*[A-Za-z]{{3}}\s*$', ''))"
    g = lambda i: rf"regexp_extract({t}, '^([\d.,]+)\s*([kK]?)\s*(?:[-–—]\s*([\d.,]+)\s*([kK]?))?$', {i})"
    kilo = f"CASE WHEN {g(2)} <> '' OR {g(4)} <> '' THEN 1000.0 ELSE 1.0 END"
    first = f"CASE WHEN {g(1)} <> '' THEN {number(g(1))} * {kilo} END"
    return first if not end else f"CASE WHEN {g(3)} <> '' THEN {number(g(3))} * {kilo} ELSE {first} END"


def skills(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    # RE2 has no look-ahead: texts get doubled separators so that matches never share one
    spaced = f"regexp_replace({t}, '([^a-z0-9+#/.-])', '\\1\\1', 'g')"
    quoted = "|".join("".join("\\" + c if c in r"\.^$*+?{}[]|()" else c for c in k) for k in sorted(sk.SKILLS, key=len, reverse=True)).replace(" ", "  ")
    found = f"regexp_extract_all({spaced}, '(?:^|[^a-z0-9])({s(quoted)})(?:[^a-z0-9+#]|$)', 1)"
    names = f"list_transform({found}, lambda w: {case_map(chr(119), {k.replace(' ', '  '): v for k, v in sk.SKILLS.items()})})"
    exact = ", ".join(f"CASE WHEN regexp_matches(coalesce({x}, ''), '(^|[^A-Za-z0-9]){n}([^A-Za-z0-9-]|$)') THEN '{n}' END" for n in sk.EXACT)
    return distinct_in_order(f"list_concat({names}, list_filter([{exact}], lambda z: z IS NOT NULL))")


def on_hosts(h: str, domains) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def reply(x: str) -> tuple[str, str, str]:
    """Kind, evidence and suggested state of a reply."""
    t = f"lower(coalesce({x}, ''))"
    hits = lambda phrases: f"list_filter([{strings(phrases)}], lambda p: contains({t}, p))"
    when = lambda then, other: "CASE " + " ".join(f"WHEN len({hits(phrases)}) > 0 THEN {then(kind, state, phrases)}" for kind, state, _, phrases in misc.REPLIES) + f" ELSE {other} END"
    later = f"CASE WHEN {' OR '.join(f'contains({t}, {chr(39)}{s(w)}{chr(39)})' for w in misc.SCHEDULING)} THEN 'Interview' ELSE 'Responded' END"
    return when(lambda k, *_: f"'{k}'", "'Unknown'"), when(lambda k, st_, ph: hits(ph), "[]"), when(lambda k, st_, ph: later if st_ is None else f"'{st_}'", "'Needs Review'")


#: Fingerprints of documents: bits set in more than half of the shingles' hashes.
FINGERPRINTS = f"""WITH w0 AS (SELECT doc_id, {words_only('text')} AS t FROM documents), w AS (SELECT doc_id, string_split(t, ' ') AS w FROM w0 WHERE length(t) >= 200),
s AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w), h AS (SELECT doc_id, ('0x' || substr(sha1(array_to_string(w[i:i + 2], ' ')), 1, 16))::UBIGINT AS v FROM s),
b AS (SELECT doc_id, v, unnest(range(64))::INTEGER AS k FROM h), g AS (SELECT doc_id, k, 2 * count(*) FILTER (WHERE (v >> k) & 1 = 1) > count(*) AS one FROM b GROUP BY doc_id, k),
fps AS (SELECT doc_id, lpad(lower(to_hex(coalesce(sum(1::UBIGINT << k) FILTER (WHERE one), 0)::UBIGINT)), 16, '0') AS fingerprint FROM g GROUP BY doc_id)
"""
