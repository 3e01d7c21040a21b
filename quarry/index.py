"""An index of one tree: versioned snapshots of its tables, and the reads over them."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import time
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import extract
from quarry import windows as win
from quarry.functions import classify, text
from quarry.operators import chunks as ch
from quarry.operators import fusion, lexical, postings, refresh, search, symbols, vectors
from quarry.settings import Settings
from quarry.sources.encoders import encoded, prefixes
from quarry.sources.tree import tree, with_text

TABLES = ("file", "symbol", "chunk", "vector")
#: Seconds after which a search's own tables may go.
SCRATCH_SECONDS = 3600
#: Texts whose vectors are kept with the first ones, to see later whether the encoder still makes the same.
CANARY = ("The harbour bridge opens twice a day for tall ships.", "for row in rows:\n    total += row.amount", "how long does a parcel take to arrive")
#: Settings that shape chunks: a change of any rebuilds the index.
SHAPING = ("coverage", "window_chars", "lexical_mode", "lexical_cap_chars", "lexical_enrich", "split_identifiers", "distill_docs", "max_chunk_lines", "embed_model", "embed_doc_prefix", "index_excluded", "doc_languages", "config_languages", "data_languages", "test_markers")


class NotIndexed(ValueError):
    pass


class Busy(RuntimeError):
    """Another refresh is at work, or was done first."""


def identity(s: Settings) -> str:
    """A fingerprint of what an index was built with."""
    shape = {k: getattr(s, k) for k in SHAPING} | {"tables": TABLES, "languages": classify.LANGUAGES, "extractor": extract.REVISION, "postings": postings.LAYOUT}
    return hashlib.blake2b(json.dumps(shape, sort_keys=True, default=list).encode(), digest_size=8).hexdigest()


class Index:
    """Versions of the tables of one tree.

    A version is a folder of a name of its own that nothing changes once a manifest names it.  A
    manifest has a number, and is put in place by a link that fails if the number is taken: of two
    refreshes that began from one version, one comes about.  Readers take the manifest of the highest
    number and keep its version to the end.  A refresh that is killed leaves a folder that no manifest
    names; the next one removes it.  Only one refresh works at a time, as long as it lives.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.spark, self.root, self.settings = spark, os.path.abspath(root), settings or Settings()
        key = f"{Path(self.root).name}-{hashlib.blake2b(self.root.encode(), digest_size=4).hexdigest()}"
        self.home = Path(self.settings.data_dir, key) if self.settings.data_dir else Path(self.root, ".quarry")

        static = self.settings.embed_backend == "static"
        #: Width of a looked-up encoder (`lookup-64`), whose table is learned with the first version; 0 for another.
        self.dims = int(self.settings.embed_model.removeprefix("lookup-")) if static and self.settings.embed_model.startswith("lookup-") else 0
        self.prefixes = prefixes(self.settings.embed_model, self.settings.embed_query_prefix, self.settings.embed_doc_prefix)

    def _encoded(self, items: DataFrame, tokens: DataFrame | None) -> DataFrame:
        """`vec` of the items' `text`; `tokens` is the version's own table, where the model looks words up."""
        s = self.settings
        if tokens is not None:
            return vectors.pooled(items, "text", tokens, self.dims)
        return encoded(items, "text", s.embed_backend, s.embed_endpoint, s.embed_model, s.embed_api_key)

    def _canary(self, tokens: DataFrame | None) -> list[list[float]]:
        items = self.spark.createDataFrame(list(enumerate(CANARY)), "i int, text string")
        return [list(map(float, r.vec)) for r in sorted(self._encoded(items, tokens).collect(), key=lambda r: r.i)]

    def _drift(self, tokens: DataFrame | None) -> str:
        """How the encoder's vectors of the fixed texts stand to the stored ones, with a warning if they moved."""
        state = vectors.drift(self.meta()["canary"], self._canary(tokens))
        if state != "same":
            warnings.warn(f"the encoder's vectors moved from the stored ones: {'the vector tier is left out, index again' if state == 'stale' else 'index again soon'}", stacklevel=3)
        return state

    # --- snapshots ---

    def _manifests(self) -> list[Path]:
        return sorted(self.home.glob("manifest-*.json"), key=lambda p: int(p.stem.split("-")[1]))

    def meta(self) -> dict:
        """The manifest of the latest version; nothing before the first."""
        for _ in range(9):  # one may go while it is looked at, but only after a later one has come
            if not (found := self._manifests()):
                return {}
            try:
                return json.loads(found[-1].read_text())
            except FileNotFoundError:
                continue
        raise Busy(f"{self.home} keeps changing")

    def table(self, name: str, m: dict | None = None) -> DataFrame:
        if not (m := m or self.meta()):
            raise NotIndexed(f"{self.root} is not indexed")
        return self.spark.read.parquet(str(self.home / m["version"] / name))

    def _keyword_index(self, m: dict) -> postings.Stored:
        return postings.Stored(str(self.home / m["version"] / "keywords"), m["buckets"])

    def _publish(self, old: dict, meta: dict) -> None:
        """Name a version, unless another was named since `old` was read."""
        number = old.get("number", 0) + 1
        draft = self.home / f"draft-{uuid.uuid4().hex}.json"
        draft.write_text(json.dumps(meta | {"number": number}))
        try:
            os.link(draft, self.home / f"manifest-{number}.json")
        except FileExistsError:
            raise Busy(f"another refresh of {self.root} was done first") from None
        finally:
            draft.unlink()

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """The one writer's place; the system frees it when a writer dies."""
        self.home.mkdir(parents=True, exist_ok=True)
        (self.home / ".gitignore").write_text("*\n")
        with (self.home / "writer").open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise Busy(f"{self.root} is being indexed") from None
            yield

    def _tidy(self, *versions: str | None) -> None:
        """Remove what no one needs: all but some versions, what killed refreshes left, old tables of searches."""
        for p in self.home.glob("v-*"):
            if p.name not in versions:
                shutil.rmtree(p, ignore_errors=True)
        for p in [*self._manifests()[:-2], *self.home.glob("draft-*.json")]:
            p.unlink(missing_ok=True)
        for p in self.home.glob("scratch/*"):
            if time.time() - p.stat().st_mtime > SCRATCH_SECONDS:
                shutil.rmtree(p, ignore_errors=True)

    def _once(self, df: DataFrame) -> DataFrame:
        """A small table that several branches of a search read, worked out once."""
        path = str(self.home / "scratch" / uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # --- writes ---

    def refresh(self, force: bool = False) -> dict:
        """Bring the tables up to the tree; {added, changed, deleted, elapsed_s}.

        Raises Busy if another refresh is at work.
        """
        with self._writing():
            before = self.meta()
            self._tidy(before.get("version"))
            return self._refresh(before, force)

    def _refresh(self, before: dict, force: bool) -> dict:
        began, s, old = time.time(), self.settings, before
        if force or old.get("identity") != identity(s):
            old = {}
        walked = tree(self.spark, self.root, s.gitignore, s.hard_exclude)
        by = classify.Categories(s.doc_languages, s.config_languages, s.data_languages, s.test_markers)
        walked = classify.indexable(walked, s.max_file_bytes, s.index_excluded, by).withColumn("file_id", F.xxhash64("path").bitwiseAND(F.lit((1 << 63) - 1)))
        version = f"v-{uuid.uuid4().hex}"
        out = self.home / version
        known = {t: self.table(t, old) for t in TABLES} if old else {}
        walked.write.parquet(str(out / "walked"))
        walked = self.spark.read.parquet(str(out / "walked"))
        if old:
            # Generated files are known too: unchanged ones are not read again.  Unreadable ones come with the next walk.
            seen = known["file"].select("path", "mtime_ns", "size").unionByName(self.table("skipped", old))
            states = refresh.diff(walked, seen).where("state <> 'same'")
            states.write.parquet(str(out / "states"))
            states = self.spark.read.parquet(str(out / "states"))
            if states.isEmpty():
                shutil.rmtree(out)
                self._publish(before, old | {"scanned": time.time()})
                return {"added": 0, "changed": 0, "deleted": 0, "elapsed_s": round(time.time() - began, 3)}
            todo = walked.join(states.where("state <> 'deleted'"), "path", "left_semi")
            gone = states.where("state <> 'added'")
        else:
            todo, gone = walked, None
        read = with_text(todo, self.root).withColumn("generated", classify.looks_generated(F.col("text")))
        read.withColumn("text", F.when(~F.col("generated"), F.col("text"))).write.parquet(str(out / "fresh"))
        read = self.spark.read.parquet(str(out / "fresh"))
        fresh, skipped = read.where("not generated").drop("generated"), read.where("generated").select("path", "mtime_ns", "size")
        if old:
            skipped = refresh.without(self.table("skipped", old), states).unionByName(skipped)
        skipped.write.parquet(str(out / "skipped"))
        files = fresh.select("file_id", "path", "mtime_ns", "size", "lang", text.humanise(F.col("path")).alias("path_words"), "content_type")
        found = extract.extracted(fresh)
        defs = found.where("tag = 'def'").withColumn("enclosing_id", F.lit(None).cast("bigint"))
        symbol = symbols.enclosed(found.where("tag = 'ref'"), defs).unionByName(defs)
        symbol = symbol.join(files.select("file_id", "path"), "file_id")
        chunk = self._chunks(fresh, defs.drop("enclosing_id"))
        tables = {"file": files, "symbol": symbol, "chunk": chunk}
        for name in TABLES[:3]:
            df = tables[name]
            if old:
                df = refresh.without(known[name], gone).unionByName(df)
            df.write.parquet(str(out / name))
        stored = self.spark.read.parquet(str(out / "chunk"))
        have = known["vector"].join(stored.select("chunk_id"), "chunk_id", "left_semi") if old else None
        need = stored.join(have.select("chunk_id"), "chunk_id", "left_anti") if old else stored
        body = F.col("text")
        if s.distill_docs:
            own = F.col("lang").isin(list(s.doc_languages)) & F.col("symbol_id").isNotNull()
            body = F.when(own, ch.embed_text(F.col("path"), body, F.col("kind"), F.col("comments"))).otherwise(body)
        tokens = None
        if self.dims:
            (self.table("token", old) if old else vectors.learned(stored, "text", self.dims)).write.parquet(str(out / "token"))
            tokens = self.spark.read.parquet(str(out / "token"))
        made = self._encoded(need.select("chunk_id", F.concat(F.lit(self.prefixes[1]), body).alias("text")), tokens).select("chunk_id", "vec")
        (have.unionByName(made) if old else made).write.parquet(str(out / "vector"))
        buckets = self._keywords(stored, old, out)
        now, prior = files.select("path"), known["file"].select("path") if old else files.select("path").limit(0)
        both = now.join(prior.withColumn("old", F.lit(1)), "path", "left").agg(F.count("*").alias("n"), F.count("old").alias("changed")).first()
        lost = prior.join(gone.select("path"), "path", "left_semi").join(now, "path", "left_anti").count() if old else 0
        for part in ("walked", "fresh", "states"):
            shutil.rmtree(out / part, ignore_errors=True)
        canary = old.get("canary") or (self._canary(tokens) if s.embed_backend != "none" else [])
        self._publish(before, {"version": version, "identity": identity(s), "scanned": time.time(), "buckets": buckets, "canary": canary})
        self._tidy(version, before.get("version"))  # readers of the version before keep theirs
        return {"added": both.n - both.changed, "changed": both.changed, "deleted": lost, "elapsed_s": round(time.time() - began, 3)}

    def _chunks(self, files: DataFrame, defs: DataFrame) -> DataFrame:
        s = self.settings
        own = ch.definition_chunks(defs, files, s.max_chunk_lines)
        windows = win.windows(files, s.window_chars)
        if s.coverage == "hybrid":
            windows = ch.uncovered(windows, defs)
        else:
            windows = windows.join(defs.select("file_id").distinct(), "file_id", "left_anti")
        both = own.unionByName(windows, allowMissingColumns=True).withColumn("position", F.col("start_line"))
        both = ch.claimed_once(both).drop("position").join(defs.select("symbol_id", "kind"), "symbol_id", "left").join(files.select("file_id", "lang", "content_type"), "file_id")
        keyword = ch.lexical_text(F.col("path"), F.col("text"), s.lexical_mode, s.lexical_cap_chars, s.lexical_enrich, s.split_identifiers)
        both = ch.with_hash(both).withColumn("keyword_text", keyword)
        return both.withColumn("chunk_id", F.xxhash64("path", "start_line", "end_line", "symbol_id", "content_hash"))

    def _keywords(self, stored: DataFrame, old: dict, out: Path) -> int:
        """The stored keyword index; returns its number of buckets.

        Postings and lengths of chunks that stay are kept, only new chunks are read.
        """
        index = self._keyword_index(old) if old else None
        lengths = self.spark.read.parquet(f"{index.folder}/lengths") if index else None
        need = stored.join(lengths.select("chunk_id"), "chunk_id", "left_anti") if index else stored
        posting, length = lexical.postings(need, "keyword_text"), lexical.lengths(need, "keyword_text")
        if index:
            stay = stored.select("chunk_id")
            posting = postings.flat(self.spark, index).join(stay, "chunk_id", "left_semi").select(*posting.columns).unionByName(posting)
            length = lengths.join(stay, "chunk_id", "left_semi").unionByName(length)
        return postings.write(posting, length, str(out / "keywords")).buckets

    def fresh(self) -> None:
        """A refresh before a read, unless the last scan is recent or refreshes are manual.

        While another refresh is at work, what there is is read; without anything, it is an error.
        """
        m = self.meta()
        if not m or (self.settings.refresh_mode == "auto" and time.time() - m["scanned"] > self.settings.rescan_after_seconds):
            try:
                self.refresh()
            except Busy:
                if not m:
                    raise

    def clear(self, dry_run: bool = False) -> bool:
        """Remove the index; a symbolic link is left alone."""
        if self.home.is_symlink() or not self.home.exists():
            return False
        if not dry_run:
            shutil.rmtree(self.home)
        return True

    # --- reads ---

    def definitions(self, name: str, langs: list[str] | None = None) -> DataFrame:
        return symbols.named(self.table("symbol").drop("path"), self.table("file"), name, "def", langs)

    def references(self, name: str, langs: list[str] | None = None) -> DataFrame:
        return symbols.named(self.table("symbol").drop("path"), self.table("file"), name, "ref", langs)

    def symbols(self, pattern: str = "*", tag: str | None = None, limit: int | None = None, content: list[str] | None = None, **scope) -> DataFrame:
        where = symbols.scope(content=classify.content_scope(content or [], self.settings.content_excluded), **scope)
        return symbols.listed(self.table("symbol").drop("path"), self.table("file"), pattern, tag, where, limit)

    def symbol_counts(self, by: str, limit: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
        found = self.symbols(**filters)
        return symbols.counted(found, by, limit), symbols.totals(found, by)

    def status(self) -> DataFrame:
        return symbols.status(self.table("file"), self.table("symbol"), self.table("chunk"))

    def search(self, queries: DataFrame, k: int = 10, content: list[str] | None = None, langs=(), include=(), exclude=()) -> DataFrame:
        """Hits of a batch of queries (query_id, query): ranked, with the evidence of each tier.

        Filters choose chunks; the keyword statistics stay those of the whole index.
        """
        s, m = self.settings, self.meta()
        asked = classify.content_scope(list(content or s.content), s.content_excluded)
        chunk = self.table("chunk", m)  # one version throughout
        where = symbols.scope(langs, asked, include, exclude)
        held = chunk.where(where)
        q = queries.withColumn("is_symbol", text.is_symbol_query(F.col("query"))).withColumn("is_prose", text.is_prose(F.col("query"), s.prose_min_words))
        ids = held.select("chunk_id")
        exact = symbols.exact(q, self.table("symbol", m).drop("path"), chunk).join(ids, "chunk_id", "left_semi").withColumn("score", F.lit(1.0))
        words = postings.search(q, self._keyword_index(m), s.candidate_depth, ids)
        tokens = self.table("token", m) if self.dims else None
        dense = s.embed_backend != "none" and self._drift(tokens) != "stale"
        near = dense and vectors.nearest(self._encoded(q.withColumn("text", F.concat(F.lit(self.prefixes[0]), "query")), tokens), self.table("vector", m).join(ids, "chunk_id", "left_semi"), s.candidate_depth)
        tiers = fusion.ranked(exact, "exact").unionByName(fusion.ranked(words, "lexical"))
        if dense:
            tiers = tiers.unionByName(fusion.ranked(near, "vector"))
        tiers = self._once(tiers)  # candidate_depth rows at most of each query and tier but the exact one
        how = search.Ranking(s.ranker, s.adaptive_alpha, s.alpha_prose, s.alpha_symbol, s.rerank, s.file_coherence, s.stem_boost, s.definition_boost, s.saturation_decay, asked == ["code"] or not asked)
        best = search.ranked(tiers, q, held, k, how).drop("path")
        name = self.table("symbol", m).select("symbol_id", "name", "signature")
        hits = best.join(held.drop("keyword_text"), "chunk_id").join(name, "symbol_id", "left").join(fusion.evidence(tiers), ["query_id", "chunk_id"], "left")
        first = F.substring(F.regexp_extract("text", r"(?m)^.*\S.*$", 0), 1, 500)
        return hits.select("query_id", "rank", "path", "start_line", "end_line", F.coalesce("name", F.lit("")).alias("name"), "score", "tiers", F.coalesce("signature", first).alias("signature"), F.col("text").alias("code"))
