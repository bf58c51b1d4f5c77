"""The SQL that says the same as those queries that SQL can express."""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x20\\x09-\\x0D]+')"


def _grams(table: str, key: str, k: int) -> str:
    """(key, g): the distinct runs of k words of each text; the whole text where it has fewer."""
    words = _WORDS.format(x="COALESCE(text, '')")
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS g
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"""


NGRAM_JOIN = f"""WITH RECURSIVE grams AS ({_grams('documents', 'doc_id', 3)}),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
  SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id)"""

DECONTAMINATE = f"""WITH dg AS ({_grams('documents', 'doc_id', 5)}), ig AS ({_grams('benchmark', 'item_id', 5)}),
  sizes AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id)
  SELECT doc_id, item_id FROM dg JOIN ig USING (g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = "replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"
CHAT_FORMAT = f"""WITH r AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(COALESCE(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(replace({_ESCAPED.format(x='role')}, chr(10), '\\n')) + length({_ESCAPED.format(x='text')})) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id"""

LINE_TEMPLATES = """WITH split_ AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  lines AS (SELECT doc_id, text, i AS pos, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM split_)),
  toks AS (SELECT *, list_transform(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM lines),
  parsed AS (SELECT *, len(m) AS n, m[1:3] AS head, array_to_string(m, ' ') AS form FROM toks WHERE len(m) > 0),
  forms AS (SELECT n, head, form, any_value(m) AS m, count(DISTINCT text) AS docs, min(doc_id) AS first_, arg_min(text, doc_id) AS owner, CAST('0x' || substring(md5(form), 1, 15) AS BIGINT) AS digest FROM parsed GROUP BY n, head, form),
  -- By rank, each form joins the first representative of its leaf that has three quarters of its tokens, or becomes one.
  folded AS (SELECT n, head, list_reduce(list_prepend({'known': list_slice([{'form': '', 'm': ['']}], 2, 1), 'out': list_slice([{'form': '', 'template': ''}], 2, 1)},
      list({'known': [{'form': form, 'm': m}], 'out': list_slice([{'form': '', 'template': ''}], 2, 1)} ORDER BY docs DESC, digest DESC)),
      lambda acc, x: {'known': CASE WHEN len(list_filter(acc.known, lambda y: 100 * list_sum(list_transform(range(1, len(y.m) + 1), lambda i: CAST(y.m[i] = x.known[1].m[i] AS INT))) >= 75 * len(y.m))) = 0
          THEN list_concat(acc.known, x.known) ELSE acc.known END,
        'out': list_append(acc.out, {'form': x.known[1].form, 'template': COALESCE(list_filter(acc.known, lambda y: 100 * list_sum(list_transform(range(1, len(y.m) + 1), lambda i: CAST(y.m[i] = x.known[1].m[i] AS INT))) >= 75 * len(y.m))[1].form, x.known[1].form)})}) AS f
    FROM forms WHERE n >= 5 GROUP BY n, head),
  template_ AS (SELECT n, head, o.form, o.template FROM (SELECT n, head, unnest(f.out) AS o FROM folded)),
  placed AS (SELECT f.*, COALESCE(t.template, f.form) AS template FROM forms f LEFT JOIN template_ t USING (n, head, form)),
  total AS (SELECT n, head, template, sum(docs) AS total, arg_min(owner, first_) AS keeper FROM placed GROUP BY n, head, template),
  known AS (SELECT p.n, p.head, p.form, keeper FROM placed p JOIN total USING (n, head, template) WHERE total >= CASE WHEN p.n < 8 THEN 10 WHEN p.n >= 50 THEN 2 ELSE 3 END),
  gone AS (SELECT doc_id, pos FROM parsed JOIN known USING (n, head, form) WHERE text <> keeper),
  kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY doc_id),
  number_ AS (SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id)
  SELECT s.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, COALESCE(n_dropped, 0) AS n_dropped, COALESCE(kept.text, '') AS text FROM split_ s LEFT JOIN kept USING (doc_id) LEFT JOIN number_ USING (doc_id)"""

SOURCE_AUDIT = f"""WITH d AS (SELECT row_number() OVER () AS r, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format(x='text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
  langs AS (SELECT lang, count(*) AS v, sum(whole) + count(*) AS all_n FROM kept GROUP BY lang),
  counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
  groups AS (SELECT lang, source, COALESCE(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
  p AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 1)) // (g.n + v) AS BIGINT) AS p,
      CAST(1 + (1000000000::HUGEINT * (whole + 1)) // all_n AS BIGINT) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(value, 0) AS value FROM groups a JOIN groups b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
  terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms QUALIFY rank <= 200"""

COLLOCATIONS = f"""WITH d AS (SELECT COALESCE(lang, 'und') AS lang, {_LOWER.format(x="COALESCE(text, '')")} AS text FROM documents),
  pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
  total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
  starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
  grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
  cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
  within AS (SELECT lang, k, a, array_to_string(ws[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)) WHERE j - i + 1 < k),
  gone AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN within USING (lang, phrase) WHERE 100 * within.a >= 100 * c.a),
  cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN total USING (lang)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:c.k], ' ')),
  best AS (SELECT * FROM cuts ANTI JOIN gone USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best QUALIFY rank <= 2000"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op3_decontaminate": DECONTAMINATE, "op7_chat_format": CHAT_FORMAT, "op9_line_templates": LINE_TEMPLATES, "op11_collocations": COLLOCATIONS, "op12_source_audit": SOURCE_AUDIT}
