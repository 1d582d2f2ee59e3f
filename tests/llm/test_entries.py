"""Every registered query over whole small tables, against plain code over the same rows."""

import hashlib
import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from conftest import SF
from test_pieces import best_path
from test_text_operators import brute_components, brute_counts, brute_hits, brute_lines, plain_fingerprint

from bytequarry.llm import entries, unigram, warc

QUERIES = entries.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(df, key="doc_id"):
    rows = df.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def types(df):
    return dict(df.dtypes)


def test_secret_scan(spark, texts):
    out = QUERIES["op1_secret_scan"](spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("candidate", "string"), ("score", "double"), ("is_secret", "boolean")]
    rows = out.collect()
    for r in rows:
        assert texts[r.doc_id][r["start"] : r["start"] + r["length"]] == r.candidate and r.is_secret == (r.score >= 0.5)
    planted = {(i, x) for i, t in texts.items() for x in re.findall('(?:token|key|secret) = "([0-9a-f]{40})"', t or "")}
    assert planted == {(r.doc_id, r.candidate) for r in rows if r.is_secret}


def test_token_counts(spark, texts):
    out, vocabulary = QUERIES["op2_token_counts"](spark, SF), unigram.Vocabulary.load()
    found = by_id(out)
    assert set(found) == set(texts)
    for i, t in texts.items():
        if len(t or "") < 1500:
            assert found[i].n_tokens == len(best_path(vocabulary, vocabulary.prepare(t or ""))), i


def test_near_dedup(spark, texts):
    out = QUERIES["op3_simhash_near_dedup"](spark, SF)
    found, ids = by_id(out), sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    assert types(out) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    for i, p, group in zip(ids, prints, brute_components(prints, 3)):
        assert (found[i].fingerprint, found[i].component_id) == (f"{p:016x}", ids[group])


def test_quality_classifier(spark, texts):
    import zlib

    out = QUERIES["op4_quality_classifier"](spark, SF)
    assert types(out) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    for i, r in by_id(out).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_line_dedup(spark, texts):
    found, ids = by_id(QUERIES["op5_line_dedup"](spark, SF)), sorted(texts)
    for i, (kept, n, dropped) in zip(ids, brute_lines([texts[i] for i in ids], 10)):
        assert (found[i].n_lines, found[i].n_dropped, found[i].kept_sha256) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())


def test_decontamination(spark, texts):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = by_id(QUERIES["op6_benchmark_decontamination"](spark, SF))
    for i in sorted(texts)[:40]:
        n, hit, ids = brute_hits((texts[i] or "")[:2500], items) if len(texts[i] or "") <= 2500 else (None,) * 3
        if n is not None:
            assert (found[i].n_words, found[i].n_hit, found[i].n_items) == (n, hit, len(ids))
            assert found[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and found[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_sentencepiece(spark, texts):
    vocabulary = unigram.Vocabulary.load()
    found = by_id(QUERIES["op7_sentencepiece"](spark, SF))
    assert set(found) == set(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in found.values())
    for i in sorted(texts)[:60]:
        if len(texts[i] or "") < 1500:
            assert found[i].ids == best_path(vocabulary, vocabulary.prepare(texts[i] or ""))


def test_quality_rules(spark, texts):
    out = QUERIES["op10_quality_rules"](spark, SF)
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["boolean"] * 2 + ["double"]
    for i, r in by_id(out).items():
        n, chars, symbols, dup, repeated = brute_counts(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)


class PlainPage(HTMLParser):
    """Text, title and links of a page by the standard library's parser."""

    HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select"}

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.parts, self.title, self.links, self.lang, self.hidden, self.in_title = base, [], [], [], "", 0, False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        self.hidden += tag in self.HIDDEN
        self.in_title = self.in_title or tag == "title"
        if tag == "a" and given.get("href") is not None:
            self.links.append(urljoin(self.base, given["href"].strip()))
        if tag == "html":
            self.lang = given.get("lang", "")
        if tag in warc._BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.in_title = self.in_title and tag != "title"
        if tag in warc._BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\n", " "))
            if self.in_title:
                self.title.append(data)


def test_warc_derivatives(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op9_warc_derivatives"](spark, SF)
    rows = {(r.page_id, r.warc_type): r for r in out.collect()}
    assert len(rows) == 2 * len(pages) == out.count()
    for i, page in pages.items():
        plain = PlainPage(page.url or "")
        plain.feed(page.html or "")
        plain.close()
        lines = [" ".join(x.split()) for x in "".join(plain.parts).split("\n")]
        text = "\n".join(x for x in lines if x)
        meta, made = rows[i, "metadata"], rows[i, "conversion"]
        assert made.block == text, i
        told = [tuple(x.split(": ", 1)) for x in meta.block.split("\r\n") if x]
        assert [v for k, v in told if k == "outlink"] == [" ".join(x.split()) for x in plain.links]
        assert [v for k, v in told if k == "title"] == ([" ".join("".join(plain.title).split())] if "".join(plain.title).strip() else [])
        assert [v for k, v in told if k == "languages-html"] == ([plain.lang] if plain.lang else [])
        assert ("http-status", "HTTP/1.1 200 OK") in told and ("http-header-Content-Length", str(len((page.html or "").encode()))) in told
        sha1 = lambda b: "sha1:" + __import__("base64").b32encode(hashlib.sha1(b).digest()).decode()
        for r in (meta, made):
            assert (r.target_uri, r.refers_to) == (page.url, meta.refers_to) and r.source_payload_digest == sha1((page.html or "").encode())
            assert r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode()) and r.record_id != r.refers_to
    assert len({r.record_id for r in rows.values()}) == len(rows) and html.unescape("&amp;") == "&"
