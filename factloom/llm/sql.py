"""DuckDB SQL for the operators whose rows SQL can give."""

from __future__ import annotations

from .pareto_mix import WEIGHTS

_CLOSURE = """reach AS (SELECT id, id AS r FROM ids UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
 parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)"""

LINKS = f"""WITH RECURSIVE fine AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT p.id AS a, q.id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.id <> q.id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
 ids AS (SELECT vec_id AS id FROM embeddings), {_CLOSURE},
 n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM parts LEFT JOIN n USING (id)"""

_ESCAPED = "length(replace(replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '|', '\\p'), '[', '\\b'))"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
 c AS (SELECT *, sum(8 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars FROM c GROUP BY 1"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 sets AS (SELECT DISTINCT doc_id AS id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
 size AS (SELECT id, count(*) AS n FROM sets GROUP BY 1),
 shared AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM sets p JOIN sets q ON p.s = q.s AND p.id <> q.id GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 ids AS (SELECT doc_id AS id FROM documents), {_CLOSURE}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM parts LEFT JOIN size USING (id)"""

MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, (('0x' || left(md5('20:' || doc_id || ':' || md5(coalesce(text, ''))), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, [{', '.join(f'{x}::DOUBLE' for x in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w, source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
 v AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT source, source_size, coalesce(least(most, w * (SELECT max(level) FROM v WHERE most / w >= level)), most) AS target FROM v),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS ratio FROM t),
 q AS (SELECT d.*, source_size, target, floor(ratio) AS whole, ratio - floor(ratio) AS f, target - floor(ratio) * source_size AS need FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
 o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN f > 0 THEN u / (1 - u) * ((1 - f) / f) END, u) - size AS before FROM q),
 k AS (SELECT *, (whole + CASE WHEN f > 0 AND before + size / 2 <= need THEN 1 ELSE 0 END)::BIGINT AS copies FROM o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k"""

ORACLES = {"op3_flat_graph": LINKS, "op4_prefix_targets": CHAT, "op9_chosen_path": NEAR, "op10_pareto_mix": MIX}

_DRAWS = ", ".join(f"('0x' || substr(sha256('1:' || doc_id), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
FIM = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_DRAWS} FROM documents),
 f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
 p AS (SELECT *, left(t, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

_PIECES = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
 g AS (SELECT lang, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM w),
 c AS (SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS s FROM g GROUP BY 1, 2 HAVING count(*) >= 10),
 cuts AS (SELECT lang, phrase, a, len(s) AS words, unnest(range(1, len(s))) AS k, s FROM c WHERE len(s) > 1),
 x AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, words, l.a AS l, r.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM cuts
  JOIN c l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.s[1:k], ' ') JOIN c r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.s[k + 1:], ' ')),
 best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_ AS (SELECT lang, phrase, max(longer) AS longest FROM (SELECT lang, array_to_string(s[1:2], ' ') AS phrase, a AS longer FROM c WHERE len(s) = 3 UNION ALL SELECT lang, array_to_string(s[2:3], ' '), a FROM c WHERE len(s) = 3) GROUP BY 1, 2),
 free AS (SELECT best.* FROM best LEFT JOIN inner_ i USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM free JOIN total USING (lang) QUALIFY rank <= 2000"""

ORACLES |= {"op11_fim_frames": FIM, "op12_line_runs": LINES, "op13_son_phrases": PHRASES}
