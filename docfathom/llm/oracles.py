"""SQL of the operators that SQL can express."""

from __future__ import annotations

from .license_scan import COVERED, LONG, NEAR, VOTES
from .license_templates import PHRASES, TEMPLATES

#: Near duplicates: all pairs that share a shingle, their overlaps, and the smallest id that links reach.
OP4 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-2), lambda i: array_to_string(w[i:i+3],' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*)>=85*(a.n+b.n-count(*))),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a=r.doc_id WHERE r.root<u.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.root AS component_id FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING(doc_id)"""

#: Repeated passages: every 100-byte window (as hexadecimal digits), the first of each, and the bytes that later ones cover.
OP6 = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substring(h, (2*p+1)::INT, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h)//2-99)) AS p FROM d)),
x AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n>1),
g AS (SELECT doc_id, p, CASE WHEN p-lag(p) OVER (PARTITION BY doc_id ORDER BY p)<=100 THEN 0 ELSE 1 END AS fresh FROM x),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p)+100 AS b FROM i GROUP BY doc_id, run),
c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a),0) AS before FROM s),
t AS (SELECT c.doc_id, string_agg(substring(h,(2*before+1)::INT,(2*(a-before))::INT),'' ORDER BY a) AS kept, sum(b-a)::BIGINT AS removed, count(*) AS spans, max(b) AS last FROM c JOIN d USING(doc_id) GROUP BY 1)
SELECT d.doc_id, (length(h)//2)::BIGINT AS n_bytes, coalesce(removed,0)::BIGINT AS n_removed, coalesce(spans,0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept||substring(h,(2*last+1)::INT) END)) AS kept_sha256 FROM d LEFT JOIN t USING(doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Licenses: phrases by comparing slices of words; three-word strings joined to those of the templates, votes by diagonal, neighbouring
#: diagonals as islands, and the template words that an island covers.
OP11 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
f(label, f) AS (VALUES {", ".join(f"('{label}', string_split('{text}',' '))" for label, text in PHRASES)}),
b AS (SELECT doc_id, label, i-1 AS k FROM (SELECT doc_id, w, label, f, unnest(range(1,len(w)-len(f)+2)) AS i FROM d, f) WHERE w[i]=f[1] AND w[i:i+len(f)-1]=f),
n AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word FROM b GROUP BY 1),
t(id, label, w) AS (VALUES {", ".join(f"({i}, '{label}', string_split('{text}',' '))" for i, (label, text) in enumerate(TEMPLATES))}),
g AS (SELECT id, label, n, i-1 AS t, array_to_string(w[i:i+2],' ') AS g FROM (SELECT *, len(w) AS n, unnest(range(1,len(w)-1)) AS i FROM t)),
p AS (SELECT doc_id, i-1 AS p, array_to_string(w[i:i+2],' ') AS g FROM (SELECT *, unnest(range(1,len(w)-1)) AS i FROM d)),
v AS (SELECT doc_id, id, label, n, p-t AS dg, list(t) AS ts FROM p JOIN g USING(g) GROUP BY 1,2,3,4,5 HAVING count(*)>=least({VOTES},n-2)),
a AS (SELECT *, CASE WHEN dg-lag(dg) OVER (PARTITION BY doc_id,id ORDER BY dg)>{NEAR} THEN 1 ELSE 0 END AS apart FROM v),
s AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id,id ORDER BY dg) AS span FROM a),
c AS (SELECT doc_id, id, label, n, count(DISTINCT t+x) AS covered FROM (SELECT *, unnest(ts) AS t FROM s), (VALUES (0),(1),(2)) AS x(x) GROUP BY doc_id,id,label,n,span),
l AS (SELECT doc_id, label, max(covered/n) AS share FROM c WHERE 100*covered>=CASE WHEN n<{LONG} THEN 100 ELSE {COVERED} END*n GROUP BY 1,2),
m AS (SELECT doc_id, max(share) AS share FROM l GROUP BY 1),
u AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM l UNION SELECT doc_id, label FROM b) GROUP BY 1),
o AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base,0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels,'') AS base_labels, coalesce(labels,'') AS labels,
CASE WHEN n_base>0 THEN 1.0 ELSE coalesce(share,0.0) END::DOUBLE AS score FROM d LEFT JOIN n USING(doc_id) LEFT JOIN m USING(doc_id) LEFT JOIN u USING(doc_id) LEFT JOIN o USING(doc_id)"""

#: Divergence of sources: every kept term of every group, absent ones too.
OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1,2 HAVING count(DISTINCT r)>=10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t SEMI JOIN k ON t.lang=k.lang AND t.term=k.term GROUP BY 1,2,3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1,2),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n,0)::HUGEINT AS n, 1+1000000000*(coalesce(c.n,0)+2)//(coalesce(s.total,0)+2*l.v) AS p, 1+1000000000*(k.n+2)//(l.total+2*l.v) AS q
 FROM g JOIN k USING(lang) JOIN l USING(lang) LEFT JOIN s ON s.lang=g.lang AND s.source=g.source LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.term=k.term),
p AS (SELECT x.lang, x.source, y.source AS item, sum((x.p-y.p)*(x.p-y.p)//(x.p+y.p)) AS value FROM a x JOIN a y ON x.lang=y.lang AND x.term=y.term AND x.source<>y.source GROUP BY 1,2,3),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(value,0) AS value FROM (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang=y.lang AND x.source<>y.source) LEFT JOIN p USING(lang, source, item)
 UNION ALL SELECT lang, source, 'term', term, (p-q)*(p-q)//(p+q) FROM a WHERE n>0 AND p>q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part='pair' OR rank<=10"""

#: Periodic runs: pairs of equal words at each distance, as islands; the hash of an id bit by bit.
OP13 = r"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR,''), lambda x: ascii(x)::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c,b), [0::BIGINT,1,2,3,4,5,6,7]), lambda x, i: CASE WHEN x&1=1 THEN xor(x>>1, 3988292384::BIGINT) ELSE x>>1 END))) AS h FROM documents),
n AS (SELECT doc_id, w, len(w) AS n, h, h//10 AS g FROM c),
a AS (SELECT *, CASE WHEN n>0 AND h%10=0 THEN g%n END AS a FROM n),
p AS (SELECT *, 1+(n-a)//(3+g%8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0,n), lambda i: CASE WHEN i<a THEN w[i+1] ELSE w[a+(i-a)%p+1] END) END AS w FROM p),
e AS (SELECT doc_id, n, i-1 AS i, w[i] AS x FROM (SELECT doc_id, n, w, unnest(range(1,n+1)) AS i FROM d)),
q AS (SELECT b.doc_id, a.i, b.i-a.i AS q FROM e a JOIN e b ON a.doc_id=b.doc_id AND a.x=b.x AND a.i<b.i WHERE 4*(b.i-a.i)<=b.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*)+q AS length FROM (SELECT *, i-row_number() OVER (PARTITION BY doc_id,q ORDER BY i) AS island FROM q) GROUP BY doc_id,q,island HAVING count(*)+q>=greatest(6,4*q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY 1,2,3),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period)=1),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start||','||length||','||period||chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id=e.doc_id AND i>=start+period AND i<start+length) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs,0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000*length//period)::BIGINT AS exponent_milli, sha256(coalesce(said,'')) AS runs_sha256, sha256(coalesce(kept,'')) AS collapsed_sha256
FROM d LEFT JOIN b USING(doc_id) LEFT JOIN m USING(doc_id) LEFT JOIN k USING(doc_id)"""
