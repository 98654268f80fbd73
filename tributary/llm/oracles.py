"""DuckDB SQL of those llm queries that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, licenses
from .queries import LISTED_HTML, URL_RULES

_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chat() -> str:
    t = chat.Template()
    known = {r: len(t.before[r]) + len(t.after[r]) for r in t.before}
    around = " ".join(f"WHEN {_text(r)} THEN {n}" for r, n in known.items())
    controls = "|".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in t.controls)
    extra = f"len(replace(x,'\\','\\\\'))+2*len(regexp_extract_all(x,'{controls}'))"
    follows = " OR ".join(f"(before={_text(a)} AND role IN ({','.join(map(_text, b))}))" for a, b in t.follows.items())
    return f"""WITH given AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7,0,'user','</s>[INST] ok [/INST]'),(-7,1,'assistant','</s>[INST] ok [/INST]')),
 r AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM given),
 b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i),'start') AS before, max(i) OVER (PARTITION BY conv_id) AS last FROM r)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||x||chr(10),'' ORDER BY i)) AS turns_sha256, cast(coalesce(sum(length(x)) FILTER (WHERE role='assistant'),0) AS bigint) AS loss_chars,
 sha256(coalesce(string_agg(x,'' ORDER BY i) FILTER (WHERE role='assistant'),'')) AS loss_sha256,
 cast({len(t.begin) + len(t.end)}+sum({extra}+CASE role {around} ELSE {sum(map(len, t.other))}+length(role) END) AS bigint) AS formatted_chars,
 cast(count(*) FILTER (WHERE NOT ({follows}))+max(CASE WHEN i=last AND role<>'assistant' THEN 1 ELSE 0 END) AS bigint) AS errors FROM b GROUP BY conv_id"""


def _urls() -> str:
    rules = []
    for action, rule in sorted(URL_RULES, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        rules.append((f"(host='{host}' OR host LIKE '%.{host}') AND starts_with(path,'/{path}')", rule, action))
    pick = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[k]}'" for r in rules) + " END"
    return f"""WITH p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url,'://([^/?#]*)',1),{_UP},{_LOW}),'') AS host, coalesce(regexp_extract(url,'://[^/?#]*([^?#]*)',1),'') AS path, regexp_extract(url,'://[^?#]*\\?([^#]*)',1) AS q FROM pages),
 c AS (SELECT *, list_sort(list_filter(string_split(q,'&'), lambda x: x<>'' AND NOT regexp_matches(x,'^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS ps FROM p),
 k AS (SELECT *, CASE WHEN contains(url,'://') THEN regexp_replace(regexp_replace(host,'^www\\.',''),':(80|443)$','')||regexp_replace(path,'/+$','')||CASE WHEN len(ps)>0 THEN '?'||array_to_string(ps,'&') ELSE '' END END AS canon FROM c),
 l AS (SELECT DISTINCT canon FROM k WHERE contains(html,{_text(LISTED_HTML)}) AND canon IS NOT NULL)
 SELECT page_id, host, path, {pick(1)} AS rule, coalesce({pick(2)}, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM k"""


_WORDS = f"regexp_extract_all(translate(coalesce(text,''),{_UP},{_LOW}),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION = f"""WITH i AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, least(10,len(w)) AS n, array_to_string(list_slice(w,k,k+least(10,len(w))-1),' ') AS win FROM (SELECT item, w, unnest(range(1,len(w)-least(10,len(w))+2)) AS k FROM i WHERE len(w)>0)),
 d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 dw AS (SELECT r, n, k, array_to_string(list_slice(w,k,k+n-1),' ') AS win FROM (SELECT r, w, n, unnest(range(1,len(w)-n+2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
 h AS (SELECT DISTINCT dw.r, dw.k, dw.n, item FROM dw JOIN iw ON dw.win=iw.win AND dw.n=iw.n),
 p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k,k+n)) AS x FROM h) GROUP BY 1),
 t AS (SELECT r, count(*) AS n_items, string_agg(item,',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1)
 SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit,0) AS bigint) AS n_hit, cast(coalesce(n_items,0) AS bigint) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""


def _licenses() -> str:
    rows = ",".join(f"({_text(n)},[{','.join(_text(b) for b in sorted(licenses.plain_bigrams(x)))}])" for n, x in licenses.TEMPLATES.items())
    words = lambda c: f"list_filter(string_split(lower(regexp_replace({c},'[^A-Za-z0-9]+',' ','g')),' '), lambda y: y<>'')"
    places = ",".join(f"({_text(w)},{i},{n})" for w, i, n in licenses.key_places(licenses.TEMPLATES, licenses.PERCENT))
    return f"""WITH t(template, own) AS (VALUES {rows}), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS x FROM documents),
 s AS (SELECT r, unnest(list_concat(string_split(x,chr(10)),string_split_regex(x,'\\n[ \\t\\r]*\\n'),[x])) AS seg FROM d),
 v AS (SELECT r, {words('seg')} AS w FROM s), nw AS (SELECT r, {words('x')} AS w FROM d),
 kp(word, off, len) AS (VALUES {places}),
 hit AS (SELECT r, unnest(w) AS word, generate_subscripts(w,1)-1 AS i FROM nw),
 win AS (SELECT DISTINCT r, greatest(i-off,0) AS low, i-off+len AS high FROM hit JOIN kp USING (word)),
 w AS (SELECT DISTINCT r, array_to_string(w,' ') AS seg, w FROM (SELECT r, w FROM v UNION ALL SELECT r, w[low+1:high] FROM win JOIN nw USING (r)) WHERE len(w)>0),
 b AS (SELECT r, seg, CASE WHEN len(w)>1 THEN list_distinct(list_transform(range(1,len(w)), lambda k: w[k]||' '||w[k+1])) ELSE list_distinct(w) END AS b FROM w),
 m AS (SELECT r, seg, template, len(list_intersect(own,b)) AS k, len(own)+len(b) AS n FROM b, t WHERE len(b)*(200-{licenses.PERCENT})>=len(own)*{licenses.PERCENT} AND len(own)*(200-{licenses.PERCENT})>=len(b)*{licenses.PERCENT}),
 g AS (SELECT *, floor(2000000.0*k/n) AS dice FROM m WHERE 200*k>={licenses.PERCENT}*n),
 o AS (SELECT r, seg, template, dice FROM (SELECT *, row_number() OVER (PARTITION BY r, seg ORDER BY dice DESC, template) AS i FROM g) WHERE i=1),
 a AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(template))),',') AS ls, arg_min(template, (-dice, template)) AS best, max(dice)/1000000 AS best_dice FROM o GROUP BY 1)
 SELECT doc_id, coalesce(n,0) AS n_matches, coalesce(ls,'') AS licenses, best, best_dice FROM d LEFT JOIN a USING (r)"""


ORACLES: dict[str, str] = {"op5_chat": _chat(), "op7_url_filter": _urls(), "op9_decontamination": _CONTAMINATION, "op10_licenses": _licenses()}
