"""Text cleaning, spelling, consolidation, annotation and concept queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import concepts, vocabulary
from ..session import spread, stage
from ..sources import annotations
from . import roles
from .roles import Tables, sql_words, with_roles

# Words that cannot start a phrase in the annotation queries.
EXCLUDED = ("the", "of", "and", "to", "in", "is", "for", "that", "with", "as")


def _labels(t: Tables) -> DataFrame:
    return t.texts().select(F.col("doc_id").alias("item_id"), F.col("text").alias("label"), "lang")


def clean_text(t: Tables) -> DataFrame:
    return vocabulary.cleaned_items(_labels(t)).select(
        "item_id", F.md5("label").alias("digest"), F.length("label").alias("n_chars")
    )


def description_tokens(t: Tables) -> DataFrame:
    tokens = tx.description_tokens("label")
    return _labels(t).select(
        "item_id",
        F.size(tokens).alias("n_tokens"),
        F.md5(F.array_join(tokens, " ")).alias("digest"),
        F.size(F.filter(tx.acronyms("label"), lambda a: a != "")).alias("n_acronyms"),
    )


def normalised_values(t: Tables) -> DataFrame:
    """Value normaliser over whole texts: digits gone, symbols blank."""
    value = tx.normalise_value("label")
    return _labels(t).select(
        "item_id", F.md5(value).alias("digest"), F.length(value).alias("n_chars")
    )


def token_counts(t: Tables) -> DataFrame:
    return vocabulary.token_counts(t.texts())


def piece_counts(t: Tables) -> DataFrame:
    return vocabulary.piece_counts(t.texts())


def _medical(t: Tables) -> DataFrame:
    return vocabulary.token_counts(t.benchmark).select("word")


def vocabulary_union(t: Tables) -> DataFrame:
    return vocabulary.build_vocabulary(
        [
            vocabulary.source_words(t.benchmark, "text"),
            vocabulary.source_words(t.part, "p_name", "item"),
            vocabulary.source_words(t.texts(), "text", "code"),
            vocabulary.source_words(t.nation, "n_name", "plain"),
        ]
    )


def spell_correct(t: Tables) -> DataFrame:
    """Corrected form of every word of the documents."""
    observed = vocabulary.token_counts(t.texts()).select("word")
    general = vocabulary.token_counts(t.part, "p_name").select("word")
    return vocabulary.correct_spelling(observed, _medical(t), general)


def consolidate_items(t: Tables) -> DataFrame:
    """Parts' descriptions, spelled against the medical and document words."""
    items = t.part.select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("label"),
    )
    rows = vocabulary.consolidate_corrected(items, _medical(t))
    return rows.select("item_id", "cleaned", "label", "canonical_id")


def consolidate_documents(t: Tables) -> DataFrame:
    rows = vocabulary.consolidate_clean(_labels(t).select("item_id", "label"))
    return rows.select("item_id", F.md5("label").alias("digest"), "canonical_id")


def drug_labels(t: Tables) -> DataFrame:
    drugs = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws(" ", "p_name", "p_brand").alias("drug_name"),
            F.col("l_returnflag").alias("route"),
            F.lit("start").alias("start"),
        )
        .distinct()
    )
    return vocabulary.drug_labels(drugs)


def _staged(t: Tables) -> DataFrame:
    micro = t.supplier.select(
        F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("item_id"),
        F.col("s_name").alias("label"),
    )
    drugs = t.customer.select(
        F.concat_ws(",", "c_name", "c_mktsegment").alias("item_id"),
        tx.clean_label("c_name").alias("label"),
    )
    labels = _labels(t)
    chart = labels.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.col("label").alias("original"),
        tx.clean_label("label").alias("corrected"),
    )
    lab = t.part.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("label"),
        F.col("p_brand").alias("fluid"),
        F.col("p_type").alias("category"),
    )
    return vocabulary.staged_documents(micro, drugs, chart, lab)


def staged_documents(t: Tables) -> DataFrame:
    return _staged(t).select("item_id", "family", F.md5("text").alias("digest"))


def _dictionary(t: Tables) -> DataFrame:
    """Phrases of one to three words of the benchmark texts as concepts."""
    w = tx.words("text")

    def grams(size: int):
        last = F.size("w") - (size - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        return F.transform(
            starts,
            lambda i: F.struct(
                F.array_join(F.slice("w", i, F.lit(size)), " ").alias("text"),
                F.lit({1: "T023", 2: "T061", 3: "T047"}[size]).alias("tui"),
            ),
        )

    phrases = t.benchmark.select(w.alias("w")).select(
        F.explode(F.concat(grams(1), grams(2), grams(3))).alias("g")
    )
    return phrases.select(
        "g.text", "g.tui", F.concat(F.lit("C"), F.substring(F.md5("g.text"), 1, 12)).alias("concept_id")
    ).distinct()


def _spans(t: Tables) -> DataFrame:
    excluded = t.spark.createDataFrame([(w,) for w in EXCLUDED], "word string")
    return concepts.annotate(t.texts().select("doc_id", "text"), _dictionary(t), excluded)


def concept_annotate(t: Tables) -> DataFrame:
    return _spans(t)


def semantic_groups(t: Tables) -> DataFrame:
    return concepts.group_concepts(_dictionary(t), concepts.semantic_groups(t.spark))


def concepts_all(t: Tables) -> DataFrame:
    return concepts.concepts_all(_spans(t))


def concepts_spanning(t: Tables) -> DataFrame:
    return concepts.concepts_spanning(stage(_spans(t), "spans"))


def concepts_longest(t: Tables) -> DataFrame:
    return concepts.concepts_longest(stage(_spans(t), "spans"))


def concept_counts(t: Tables) -> DataFrame:
    made = concepts.item_concepts(stage(_spans(t), "spans"))
    return concepts.concept_counts(made)


def xml_spans(t: Tables) -> DataFrame:
    """Spans read back from annotation XML made of each part's name."""
    ref, concept, array = annotations.REFERENCE, annotations.CONCEPT_ELEMENT, annotations.ARRAY_ELEMENT
    found = tx.located_words("p_name")

    def element(w, i):
        n = (i + 1).cast("string")
        lit = F.lit
        return F.concat(
            lit(f'<textsem.Mention {ref}="a'), n, lit('" begin="'), w["begin"].cast("string"),
            lit('" end="'), w["end"].cast("string"), lit(f'"/><{array} _id="a'), n, lit('"><i>c'), n,
            lit(f'</i></{array}><{concept} _id="c'), n, lit('" cui="'), w["word"], lit('"/>'),
        )

    xml = F.concat(F.lit("<CAS>"), F.array_join(F.transform(found, element), ""), F.lit("</CAS>"))
    docs = spread(t.part, "p_partkey").select(F.col("p_partkey").alias("doc_id"), xml.alias("xml"))
    return annotations.concept_spans(docs)


QUERIES = {
    f.__name__: f
    for f in (
        clean_text,
        description_tokens,
        normalised_values,
        token_counts,
        piece_counts,
        vocabulary_union,
        spell_correct,
        consolidate_items,
        consolidate_documents,
        drug_labels,
        staged_documents,
        concept_annotate,
        semantic_groups,
        concepts_all,
        concepts_spanning,
        concepts_longest,
        concept_counts,
        xml_spans,
    )
}

# --- SQL ---------------------------------------------------------------------


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _blank(column: str, symbols: str, deleted: str = "") -> str:
    """``translate`` with surplus characters deleted."""
    return f"translate({column}, {_quote(symbols + deleted)}, '{' ' * len(symbols)}')"


def _clean(column: str) -> str:
    """Abbreviations by map look-up, symbols blanked, lower case; null if empty."""
    pairs = ", ".join(f"{_quote(k)}: {_quote(v)}" for k, v in tx.abbreviation_lookup().items())
    expanded = (
        f"array_to_string(list_transform(string_split({column}, ' '), "
        f"lambda x: coalesce((MAP {{{pairs}}})[x], x)), ' ')"
    )
    body = _blank(expanded, tx.LABEL_SYMBOLS, tx.LABEL_DELETED)
    return f"CASE WHEN {column} <> '' THEN lower({body}) END"


_PIECES = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[ ,;]'), lambda x: x <> '')"
_NORMAL = (
    f"lower({_blank('text', tx.VALUE_SYMBOLS, tx.DIGITS)})"
)


def _distinct_words(table: str, column: str, least: int = 2) -> str:
    return f"SELECT DISTINCT unnest({sql_words(column, least)}) AS word FROM {table}"


# DuckDB counts edits in bytes: give the accented letters one byte each (the
# words are lower case, so capitals are free).
_ONE_BYTE = "translate(word, 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS b"
_SPELLING = {
    "med": _distinct_words("benchmark", "text"),
    "gen": _distinct_words("part", "p_name"),
    "seen": _distinct_words("documents", "text"),
    "unknown": f"""SELECT word, {_ONE_BYTE}, length(word) AS n FROM seen
        WHERE word NOT IN (SELECT word FROM med) AND word NOT IN (SELECT word FROM gen)""",
    "target": f"SELECT word, {_ONE_BYTE}, length(word) AS n FROM med",
}


def _nearest(k: int, words: str) -> dict[str, str]:
    """Best matches of ``words`` up to ``k`` edits, by pieces one of which is left whole, and words left over."""
    begin, end = f"(i * n // {k + 1})", f"((i + 1) * n // {k + 1})"
    low = f"greatest({begin} - i, {begin} + m - n - {k} + i, 0)"
    high = f"least({begin} + i, {begin} + m - n + {k} - i, m - {end} + {begin})"
    return {
        f"piece{k}": f"""SELECT word, b, n, i, substr(b, {begin} + 1, {end} - {begin}) AS piece
            FROM (SELECT *, unnest(range({k + 1})) AS i FROM {words} WHERE n > {k})""",
        f"place{k}": f"""SELECT w, mb, n, i, substr(mb, pos + 1, {end} - {begin}) AS piece
            FROM (SELECT *, unnest(range({low}, {high} + 1)) AS pos
              FROM (SELECT *, unnest(range({k + 1})) AS i
                FROM (SELECT word AS w, b AS mb, n AS m,
                        unnest(range(greatest(n - {k}, {k + 1}), n + {k + 1})) AS n FROM target)))""",
        f"best{k}": f"""SELECT word, min({{'d': d, 'w': w}}) AS b
            FROM (SELECT word, w, levenshtein(b, mb) AS d FROM
              (SELECT DISTINCT word, b, w, mb FROM piece{k} JOIN place{k} USING (n, i, piece)))
            WHERE d <= {k} GROUP BY word""",
        f"open{k}": f"SELECT * FROM {words} WHERE word NOT IN (SELECT word FROM best{k})",
    }


# Two, three, then four edits by equality; the few words left against all.
_SPELLING |= _nearest(2, "unknown") | _nearest(3, "open2") | _nearest(4, "open3")
_SPELLING |= {
    "far": """SELECT word, min({'d': d, 'w': w}) AS b
        FROM (SELECT u.word, u.n, m.word AS w, levenshtein(u.b, m.b) AS d FROM open4 u, target m)
        WHERE d < n GROUP BY word""",
    "best": "FROM best2 UNION ALL FROM best3 UNION ALL FROM best4 UNION ALL FROM far",
}

_CONSOLIDATED = {
    "med": _distinct_words("benchmark", "text"),
    "cleaned": f"""SELECT CAST(p_partkey AS VARCHAR) AS item_id,
        {_clean("p_name || ' ' || p_type")} AS cleaned FROM part""",
    "seen": f"SELECT DISTINCT unnest({sql_words('cleaned', 2)}) AS word FROM cleaned",
    "best": f"""SELECT word, min({{'d': d, 'w': w}}) AS b
        FROM (SELECT u.word, m.word AS w, levenshtein(u.b, m.b) AS d
              FROM (SELECT word, {_ONE_BYTE} FROM seen) u, (SELECT word, {_ONE_BYTE} FROM med) m
              WHERE u.word NOT IN (SELECT word FROM med))
        WHERE d < length(word) GROUP BY word""",
    "fixed": f"""SELECT item_id, any_value(cleaned) AS cleaned,
        string_agg(coalesce(b.w, tok), ' ' ORDER BY pos) AS label
        FROM (SELECT item_id, cleaned, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
              FROM (SELECT *, {_PIECES.format('cleaned')} AS toks FROM cleaned))
        LEFT JOIN best ON best.word = tok GROUP BY item_id""",
}

_DICTIONARY = {
    "bw": f"SELECT {sql_words('text')} AS w FROM benchmark",
    "dictionary": """SELECT DISTINCT text, tui, 'C' || substr(md5(text), 1, 12) AS concept_id FROM ("""
    + " UNION ALL ".join(
        f"""SELECT array_to_string(w[i:i + {n - 1}], ' ') AS text, '{tui}' AS tui
            FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM bw)"""
        for n, tui in ((1, "T023"), (2, "T061"), (3, "T047"))
    )
    + ")",
}
_STOP = ", ".join(_quote(w) for w in EXCLUDED)
_ANNOTATED = {
    **_DICTIONARY,
    "keys": """SELECT DISTINCT len(t) AS n, t[1] AS first, list_sort(t[2:]) AS rest, concept_id
        FROM (SELECT string_split(text, ' ') AS t, concept_id FROM dictionary)""",
    "pieces": r"""SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p
              FROM documents)""",
    "located": r"""SELECT *, stop - length(piece) AS start FROM
        (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM pieces)
        WHERE regexp_matches(piece, '^[\p{L}\p{N}_]')""",
    "windows": """SELECT doc_id, start, lower(piece) AS w1, stop AS e1,
        lower(lead(piece, 1) OVER d) AS w2, lead(stop, 1) OVER d AS e2,
        lower(lead(piece, 2) OVER d) AS w3, lead(stop, 2) OVER d AS e3
        FROM located WINDOW d AS (PARTITION BY doc_id ORDER BY pos)""",
    "spans": f"""SELECT doc_id, concept_id, CAST(start AS INTEGER) AS "begin",
        CAST("end" AS INTEGER) AS "end" FROM (
          SELECT doc_id, start, e1 AS "end", 1 AS n, w1 AS first, CAST([] AS VARCHAR[]) AS rest
            FROM windows
          UNION ALL SELECT doc_id, start, e2, 2, w1, [w2] FROM windows WHERE w2 IS NOT NULL
          UNION ALL SELECT doc_id, start, e3, 3, w1, list_sort([w2, w3]) FROM windows
            WHERE w3 IS NOT NULL)
        JOIN keys USING (n, first, rest) WHERE first NOT IN ({_STOP})""",
}
_CHOSEN = {
    **_ANNOTATED,
    "outer_spans": """SELECT s.* FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans t
        WHERE t.doc_id = s.doc_id AND t."begin" <= s."begin" AND s."end" <= t."end"
          AND t."end" - t."begin" > s."end" - s."begin")""",
    "long_spans": """SELECT * FROM (SELECT *, rank() OVER (PARTITION BY doc_id
        ORDER BY "end" - "begin" DESC) AS r FROM spans) WHERE r = 1""",
    "a": "SELECT DISTINCT doc_id, concept_id FROM spans",
    "s": "SELECT DISTINCT doc_id, concept_id FROM outer_spans",
    "l": "SELECT DISTINCT doc_id, concept_id FROM long_spans",
}
_GROUPS = ", ".join(
    f"('{code}', '{g}')" for g, codes in concepts.SEMANTIC_GROUPS.items() for code in codes.split()
)

ORACLES = {
    "clean_text": f"""SELECT doc_id AS item_id, md5(c) AS digest, CAST(length(c) AS INTEGER) AS n_chars
        FROM (SELECT doc_id, {_clean('text')} AS c FROM documents) WHERE c IS NOT NULL""",
    "description_tokens": f"""SELECT doc_id AS item_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens,
        md5(array_to_string({_TOKENS}, ' ')) AS digest,
        CAST(len(list_filter(string_split(text, ' '),
          lambda x: x <> '' AND regexp_full_match(x, '\\p{{Lu}}+'))) AS INTEGER) AS n_acronyms
        FROM documents""",
    "normalised_values": f"""SELECT doc_id AS item_id, md5(v) AS digest,
        CAST(length(v) AS INTEGER) AS n_chars
        FROM (SELECT doc_id, CASE WHEN trim({_NORMAL}, ' ') <> '' THEN {_NORMAL} END AS v
              FROM documents)""",
    "token_counts": f"""SELECT word, count(*) AS n FROM
        (SELECT unnest({sql_words('text', 2)}) AS word FROM documents) GROUP BY word""",
    "piece_counts": f"""SELECT word, count(*) AS n FROM
        (SELECT unnest({_PIECES.format('c')}) AS word
         FROM (SELECT {_clean('text')} AS c FROM documents)) GROUP BY word""",
    "vocabulary_union": f"""SELECT DISTINCT word FROM (
        SELECT unnest({_PIECES.format('c')}) AS word FROM (SELECT {_clean('text')} AS c FROM benchmark)
        UNION ALL SELECT unnest({_PIECES.format('c')}) FROM
          (SELECT {_clean("array_to_string(" + _TOKENS.replace('text', 'p_name') + ", ' ')")} AS c FROM part)
        UNION ALL SELECT unnest({_PIECES.format('c')}) FROM
          (SELECT lower({_blank('text', tx.LABEL_SYMBOLS + '.', '#')}) AS c FROM documents)
        UNION ALL SELECT n_name FROM nation)""",
    "spell_correct": with_roles(
        (),
        "SELECT word, coalesce(b.w, word) AS corrected FROM seen LEFT JOIN best USING (word)",
        **_SPELLING,
    ),
    "consolidate_items": with_roles(
        (),
        "SELECT *, min(item_id) OVER (PARTITION BY label) AS canonical_id FROM fixed",
        **_CONSOLIDATED,
    ),
    "consolidate_documents": f"""SELECT item_id, md5(label) AS digest,
        min(item_id) OVER (PARTITION BY label) AS canonical_id
        FROM (SELECT CAST(doc_id AS VARCHAR) AS item_id,
                array_to_string({_PIECES.format('c')}, ' ') AS label
              FROM (SELECT doc_id, {_clean('text')} AS c FROM documents) WHERE c IS NOT NULL)""",
    "drug_labels": f"""SELECT drug || ',' || route || ',start' AS item_id,
        {_clean('drug')} || ',' || route || ',start' AS label
        FROM (SELECT DISTINCT p_name || ' ' || p_brand AS drug, l_returnflag AS route
              FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "staged_documents": f"""
        SELECT s_suppkey || ',' || s_nationkey AS item_id, 'microbiology' AS family,
          md5({_blank('s_name', tx.STAGING_SYMBOLS)}) AS digest FROM supplier
        UNION ALL SELECT c_name || ',' || c_mktsegment, 'drug', md5({_clean('c_name')}) FROM customer
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'chart',
          md5({_blank('text', tx.STAGING_SYMBOLS)} || chr(10) || {_clean('text')}) FROM documents
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'lab',
          md5({_blank("p_name || ' ' || p_brand || ' ' || p_type", tx.STAGING_SYMBOLS)}) FROM part""",
    "concept_annotate": with_roles((), "SELECT * FROM spans", **_ANNOTATED),
    "semantic_groups": with_roles(
        (),
        """SELECT DISTINCT concept_id, tui, concept_group FROM dictionary JOIN groups USING (tui)""",
        **_DICTIONARY,
        groups=f"SELECT * FROM (VALUES {_GROUPS}) g(tui, concept_group)",
    ),
    "concepts_all": with_roles((), "SELECT * FROM a", **_CHOSEN),
    "concepts_spanning": with_roles((), "SELECT * FROM s", **_CHOSEN),
    "concepts_longest": with_roles((), "SELECT * FROM l", **_CHOSEN),
    "concept_counts": with_roles(
        (),
        "\nUNION ALL\n".join(
            f"SELECT doc_id AS item_id, '{m}' AS method, count(*) AS n_concepts FROM {n} GROUP BY doc_id"
            for m, n in (("all", "a"), ("spanning", "s"), ("longest", "l"))
        ),
        **_CHOSEN,
    ),
    "xml_spans": r"""SELECT DISTINCT doc_id, piece AS concept_id,
        CAST(stop - length(piece) AS INTEGER) AS "begin", CAST(stop AS INTEGER) AS "end" FROM
        (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM
          (SELECT p_partkey AS doc_id, unnest(p) AS piece, unnest(range(len(p))) AS pos
           FROM (SELECT p_partkey, regexp_extract_all(p_name, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p
                 FROM part)))
        WHERE regexp_matches(piece, '^[\p{L}\p{N}_]')""",
}
