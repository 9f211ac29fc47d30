"""Queries of the retrieval engine on the test tables, and the SQL that each must equal.

`documents` plays the corpus, with source as file name and lang as file type;
`embeddings` its vectors (vec_id is doc_id); `conversations` the chat;
`events` jobs, stages, traces and requests; `orders` and `lineitem` documents
and their chunks; `labels` outcomes; `benchmark` questions.
"""

from quire.catalogue import reports, search, text

QUERIES = {**search.QUERIES, **text.QUERIES, **reports.QUERIES}
ORACLE_SQL = {**search.ORACLE_SQL, **text.ORACLE_SQL, **reports.ORACLE_SQL}
