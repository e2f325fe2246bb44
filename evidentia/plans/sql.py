"""SQL of the corpus mapping, shared by the statements that check the queries."""

PAPER_ID = "printf('%02d%02d.%05d', 15 + doc_id % 12, 1 + doc_id % 12, doc_id)"

PAPERS = f"""papers AS (
  SELECT {PAPER_ID} AS arxiv_id, substr(string_split(text, chr(10))[1], 1, 80) AS title, source, text AS abstract,
    embedding AS abstract_embedding, doc_id
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id
)"""


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode({name}))"
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12)
      FROM (SELECT {h} AS h))"""


KINDS = "['Background Study', 'Literature Review', 'Methodology', 'Experiment', 'Result/Discussion', 'Future Work', 'Other']"

LINES = f"""split_lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, {PAPER_ID} AS arxiv_id, i AS section_order, {KINDS}[(doc_id + i) % 7 + 1] AS section_type, l[i + 1] AS chunk_text
  FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS i FROM split_lines)
), hashed AS (
  SELECT *, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(arxiv_id || ':' || section_type || ':' || section_order)) AS h
  FROM lines WHERE trim(chunk_text, ' ') <> ''
), chunks AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS chunk_uuid,
    arxiv_id, section_type, section_order, chunk_text, doc_id,
    len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda w: w <> '')) AS token_count
  FROM hashed
), vector_chunks AS (
  SELECT c.*, e.embedding AS chunk_embedding FROM chunks c JOIN embeddings e ON (c.doc_id * 31 + c.section_order) % (SELECT count(*) FROM embeddings) = e.vec_id
)"""


def query(n: int) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {n})"


def terms(text: str) -> str:
    """Distinct words of a text, as the token overlap counts them."""
    norm = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"


def overlap(query_: str, text: str) -> str:
    wanted = sorted(set(query_.lower().split()))
    return f"(len(list_intersect([{', '.join(repr(w) for w in wanted)}], {terms(text)})) / {len(wanted)}.0)"
