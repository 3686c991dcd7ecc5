"""Personal data in texts, and terms that give it away, with DataFrame and SQL functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers; numbers that a longer run of digits
swallows are added, and so are secrets (a value that looks drawn, behind a name such as token or password, and keys of known
make). The method adds terms: words that go with an identifier, from which it could be guessed. A term t
discloses an identifier e if at least SUPPORT different texts hold both (or t stands within REACH characters of e in as many
different windows, be it in one document) and if, of all documents of the corpus that hold t, at least a share of
DISCLOSURE hold e anywhere in their text; seeing t then narrows the identifier down by log2(P(e | t) / P(e)) bits, of
which at least BITS are needed. A disclosing term is generalised wherever it stands, in documents without the identifier
as well; from a share of CERTAIN on it is removed.

Plan: one pass over the texts lists base spans and the window around each (a written table without the texts). An
identifier in more than 2**-BITS of all documents cannot be disclosed and is left out, and so is a term in more than that
or mostly in documents without such identifiers; only for the terms that remain are (identifier, term) pairs counted, with
partial aggregation. The disclosing terms are then looked up in all whole texts: one pass names the documents that hold
one, and the places of words are listed in these alone. No group is gathered except the spans of one document. The patterns
use possessive loops and look behind, so that matching takes linear time and no deep stack on texts without white space;
they match what the plain patterns match.

Null or empty text: no spans. Rows of one doc_id with different texts each get the spans of their own text; in counts of
documents they are one row each. Null doc_ids: base spans, swallowed numbers and secrets only. Other columns are kept by ``sanitise`` and not read. An empty table gives no rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.stage import stage

from .common import BROADCAST_IDS, only, table, without

REACH, SUPPORT, DISCLOSURE, CERTAIN, BITS = 100, 2, 0.5, 0.9, 6.0
KINDS = ("email", "ip", "card", "phone", "term", "secret")

#: From a run's first character, or from where the last match ended.
_EMAIL = r"[A-Za-z0-9._%+-](?:(?<![A-Za-z0-9._%+-]{2})|(?<=\G[A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
#: 14 to 19 digits from the first digit of a chain to its last.
_CARD = r"[0-9](?<![0-9]{2})(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Cards in their usual groups and phone numbers of few groups, which the wider patterns swallow where more digits follow.
_OWN_CARD = r"[0-9](?<![0-9]{2})(?:[0-9]{13,18}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])"
_OWN_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,3}(?![0-9])"
#: A named value of 16 characters or more with a digit in it, and keys that tell themselves by their first characters.
_SECRET = (r"(?:(?i:tokens?|secrets?|passwords?|passwd|credentials?|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|secret[_-]?access[_-]?key)[\x22']?[ \t]*+[:=][ \t]*+[\x22']?(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,}+=*+[\x22']?"
           r"|\b(?:sk-|AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{16,}+|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)")
#: Of these one is in every text that holds a secret.
_SECRET_SIGNS = ("=", ":", "sk-", "AKIA", "ASIA", "gh", "xox", "AIza", "glpat-", "eyJ")
_WORD = r"[^\p{L}\p{N}]+"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: str, pattern: str, kind: int, start: str, value: str) -> str:
    """SQL for the spans of a pattern's matches (pattern: an SQL expression), which lie between the pieces that a split
    leaves. Places are summed in chunks, so that a text of very many matches takes no quadratic time."""
    return f"""transform(array(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (a, b) -> struct(a, b))), z ->
      transform(array(transform(sequence(0, size(z) div 256), c -> slice(z, c * 256 + 1, 256))), chunks ->
        flatten(zip_with(chunks, aggregate(chunks, named_struct('at', {start}, 'o', cast(array() as array<int>)),
            (s, c) -> named_struct('at', s.at + aggregate(c, 0, (t, x) -> t + char_length(x.a) + coalesce(char_length(x.b), 0)), 'o', concat(s.o, array(s.at))), s -> s.o),
          (c, o) -> aggregate(c, named_struct('at', o, 'out', cast(array() as {_SPAN})),
            (s, x) -> case when x.b is null then s else named_struct('at', s.at + char_length(x.a) + char_length(x.b),
              'out', concat(s.out, array(named_struct('start', s.at + char_length(x.a), 'kind', {kind}, 'end', s.at + char_length(x.a) + char_length(x.b), 'value', {value})))) end,
            s -> s.out))))[0])[0]"""


def _found(text: str, kind: int, pattern: str, good: str, needs: str) -> Column:
    """Spans of the matches that pass."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"""case when {needs} and {text} rlike {p} then filter({_matches(text, p, kind, '0', 'x.b')}, x -> {good.format(v='x.value')})
      else cast(array() as {_SPAN}) end""")


_GOOD_IP = r"forall(split({v}, '[.]'), p -> coalesce(try_cast(regexp_replace(p, '^0+(?=.)', '') as int) <= 255, false))"
_GOOD_PHONE = r"length(regexp_replace({v}, '[^0-9]', '')) between 10 and 15"
_GOOD_CARD = r"""aggregate(transform(filter(split(reverse({v}), ''), c -> c >= '0' and c <= '9'), (c, i) -> int(c) * (1 + i % 2) - if(i % 2 = 1 and c >= '5', 9, 0)), 0, (s, d) -> s + d) % 10 = 0"""


def base_spans(text: str) -> Column:
    """Base spans of a text column, by start and kind. The column's name must be plain."""
    t = f"coalesce({text}, '')"
    kinds = [_found(t, 0, _EMAIL, "true", f"contains({t}, '@')"), _found(t, 1, _IP, _GOOD_IP, "true"),
             _found(t, 2, _CARD, _GOOD_CARD, "true"), _found(t, 3, _PHONE, _GOOD_PHONE, f"contains({t}, '+')")]
    return F.array_sort(F.concat(*kinds))


def swallowed_spans(text: str, base: str) -> Column:
    """Cards and phone numbers within longer runs of digits, and secrets, apart from the base spans."""
    t = f"coalesce({text}, '')"
    signs = " or ".join(f"contains({t}, '{x}')" for x in _SECRET_SIGNS)
    kinds = [_found(t, 2, _OWN_CARD, _GOOD_CARD, "true"), _found(t, 3, _OWN_PHONE, _GOOD_PHONE, f"contains({t}, '+')"), _found(t, 5, _SECRET, "true", f"({signs})")]
    return F.filter(F.array_sort(F.concat(*kinds)), lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def joined(spans: str) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def _windows(base: DataFrame) -> DataFrame:
    """(doc_id, entity, at, window): the text around each base span; a letter stands where a word may be cut."""
    one = base.where("size(spans) > 0").select("doc_id", F.explode("around").alias("a"))
    return one.select("doc_id", F.col("a.entity").alias("entity"), F.col("a.at").alias("at"), F.col("a.window").alias("window"))


def _terms(text: str) -> Column:
    """The different words of a text in lower case, of which each character stands for one of the text's."""
    return F.array_distinct(F.split(F.lower(F.translate(F.col(text), "\u0130", "i")), _WORD))


def _held(docs: DataFrame, text: str, *kept: str | Column) -> DataFrame:
    """The kept columns and term, a row for each different word of a document."""
    return docs.select(*kept, F.explode(_terms(text)).alias("term")).where(F.length("term") >= 3)


def disclosing_terms(windows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, share) of the terms that give an identifier away. windows: (doc_id, entity, at, window)."""
    n = docs.count()
    least = 2.0 ** BITS
    # P(e | t) is 1 at most, so an identifier of more documents gives too few bits.
    pairs = windows.select("doc_id", "entity").distinct()
    of = stage(pairs.groupBy("entity").agg(F.count("*").alias("docs")).where(F.col("docs") * least <= n), "entities")
    holders = stage(pairs.join(of, "entity"), "holders")
    ids = stage(holders.select("doc_id").distinct(), "holder-ids")
    inside = _held(only(docs, ids, "doc_id"), text, "doc_id", F.xxhash64(text).alias("same"))
    # Windows count by themselves, since they may lie in one document.
    near = _held(windows.join(of, "entity", "left_semi"), "window", "entity", F.xxhash64("window").alias("context"))
    near = stage(near.groupBy("entity", "term").agg((F.min("context") != F.max("context")).alias("near")).where("near"), "near")
    known = stage(inside.groupBy("term").agg(F.count("*").alias("inside"), (F.min("same") != F.max("same")).alias("many")).where("many").select("term", "inside")
                  .unionAll(near.select("term", F.lit(None).cast("bigint"))).groupBy("term").agg(F.max("inside").alias("inside")), "known")
    df = only(_held(docs, text), known.select("term"), "term").groupBy("term").agg(F.count("*").alias("df"))
    # both <= docs and both <= inside: what fails here fails for every identifier.
    terms = stage(df.join(known, "term").where((F.col("df") * least <= n) & (F.coalesce("inside", "df") >= DISCLOSURE * F.col("df"))).select("term", "df"), "terms")
    both = only(inside, terms.select("term"), "term").join(holders, "doc_id").groupBy("entity", "term", "docs").agg(F.count("*").alias("both"), (F.min("same") != F.max("same")).alias("many"))
    share = F.least(F.col("both") / F.col("df"), F.lit(1.0))
    return (both.join(near, ["entity", "term"], "left").where("many or near").join(terms, "term").withColumn("share", share)
            .where((F.col("share") >= DISCLOSURE) & (F.log2(F.col("share") * n / F.col("docs")) >= BITS)).select("entity", "term", "share"))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, same, base, added): arrays of (start, kind, end, value), sorted; a term's value is '' if it is to be removed.
    Added are swallowed numbers, secrets and disclosing terms; same is a hash of the text, which tells rows of one doc_id apart."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("same", F.xxhash64("text"))
    around = F.expr(f"""transform(spans, s -> named_struct('entity', lower(s.value), 'at', greatest(s.start - {REACH}, 0) - if(s.start > {REACH}, 1, 0),
        'window', concat(if(s.start > {REACH}, 'x', ''), substring(text, greatest(s.start - {REACH}, 0) + 1, s.end - greatest(s.start - {REACH}, 0) + {REACH}), if(s.end + {REACH} < char_length(text), 'x', ''))))""")
    base = stage(plain.withColumn("spans", base_spans("text")).withColumn("swallowed", swallowed_spans("text", "spans")).withColumn("around", around).select("doc_id", "same", "spans", "swallowed", "around"), "base")
    windows = _windows(base.where("doc_id is not null"))
    giving = stage(disclosing_terms(windows, plain).groupBy("term").agg(F.max("share").alias("share")), "giving")
    few = giving.count() <= BROADCAST_IDS
    named = plain.where("doc_id is not null")
    hits = stage(only(_held(named, "text", "doc_id"), giving.select("term"), "term").select("doc_id").distinct(), "hits")
    placed = F.expr(_matches("text", r"'[\\p{L}\\p{N}]++'", 4, "0", "lower(translate(x.b, '\u0130', 'i'))"))
    words = only(named, hits, "doc_id").select("doc_id", "same", F.explode(placed).alias("s")).select("doc_id", "same", "s", F.col("s.value").alias("term"))
    words = words.join(F.broadcast(giving) if few else giving, "term")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.when(F.col("share") >= CERTAIN, "").otherwise(F.col("term")).alias("value"))
    spans = stage(words.groupBy("doc_id", "same").agg(F.collect_set(span).alias("terms")), "term-spans")
    free = F.expr("filter(coalesce(terms, array()), t -> not exists(concat(spans, swallowed), b -> b.start < t.end and t.start < b.end))")
    return base.select("doc_id", "same", "spans", "swallowed").join(spans, ["doc_id", "same"], "left").select("doc_id", "same", F.col("spans").alias("base"), F.array_sort(F.concat("swallowed", free)).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """The digest of (doc_id, base, added): counts, base_sha256 and spans."""
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    every = found.withColumn("all", F.array_sort(F.concat("base", "added")))
    return every.select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))


def _replaced(text: str, spans: str) -> Column:
    """The text with its spans replaced; unchanged where spans are null."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    return F.expr(f"""case when {spans} is null then {text} else aggregate({spans}, named_struct('at', 0, 'out', ''),
        (a, s) -> case when s.start < a.at then named_struct('at', greatest(a.at, s.end), 'out', a.out) else named_struct('at', s.end,
          'out', concat(a.out, substring({text}, a.at + 1, s.start - a.at), if(s.kind = 4 and s.value = '', '', element_at(array({names}), s.kind + 1)))) end,
        a -> concat(a.out, substring({text}, a.at + 1))) end""")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with identifiers replaced by their kind in brackets and disclosing terms generalised or removed. Spans that
    touch are replaced as one, by the first one's kind. Texts without spans stay as they are."""
    found = find_spans(docs, doc_id, text).where("size(base) + size(added) > 0 and doc_id is not null").dropDuplicates(["doc_id", "same"])
    found = stage(found.select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), F.array_sort(F.concat("base", "added")).alias("__spans")), "spans")
    # Only texts that hold some span are joined (and shuffled); the others pass.
    ids = stage(found.select("__id").distinct(), "span-ids")
    plain = docs.withColumn("__id", F.col(doc_id).cast("bigint")).withColumn("__same", F.xxhash64(text))
    rest = without(plain.where("__id is not null"), ids, "__id").select(*docs.columns)
    bare = plain.where("__id is null").withColumn("__spans", base_spans(f"`{text}`")).withColumn("__spans", F.array_sort(F.concat("__spans", swallowed_spans(f"`{text}`", "__spans"))))
    plain = only(plain, ids, "__id").join(found, ["__id", "__same"], "left").select(*bare.columns).unionAll(bare).withColumn(text, _replaced(f"`{text}`", "__spans"))
    # What a dropped match had kept from matching may match now.
    for _ in range(2):
        plain = plain.withColumn("__spans", F.when(F.col("__spans").isNotNull(), base_spans(f"`{text}`"))).withColumn(text, _replaced(f"`{text}`", "__spans"))
    return plain.select(*docs.columns).unionAll(rest)


def op7_disclosure(spark, folder: str) -> DataFrame:
    return report(find_spans(table(spark, folder, "documents")))
