"""Language ID by unigrams over a fixed public piece vocabulary, all segmentations summed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, per_worker, release_memory, small_batches

#: Scale of a character's probability in the forward sums: they stay near 1, whatever a word's length.
PER_CHAR = 16.0
#: Probability of a character that no piece spells, the same in each language.
UNKNOWN = 1e-7
#: Stands for the space before a word in the vocabulary.
SPACE = "▁"
#: Words from this length on are trained one by one, in logarithms.
LONGEST_TRAINED = 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """All ways to spell words in the pieces of a sentencepiece model (its control and byte pieces left out).

    The pieces stand in a trie that is walked from all characters at once. Its 126 most used characters have a dense table
    of steps, the others a sorted list.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.length = np.ones(self.size + 1, np.int64)
        pieces = {}
        for i in range(self.size):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
                self.length[i] = len(model.id_to_piece(i))
        self.longest = int(self.length.max())
        steps, ends = {}, [-1]
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends)
        used = Counter(c for _, c in steps)
        self.code = np.zeros(0x110000, np.uint8)  # 0: in no piece
        for k, (c, _) in enumerate(used.most_common()):
            self.code[ord(c)] = min(k + 1, 127)
        self.dense = np.zeros((len(ends), 128), np.int32)
        rare = []
        for (node, c), to in steps.items():
            if self.code[ord(c)] < 127:
                self.dense[node, self.code[ord(c)]] = to
            else:
                rare.append((node << 21 | ord(c), to))
        rare.sort()
        self.rare, self.rare_to = (np.array([x[k] for x in rare], np.int64) for k in (0, 1))

    def walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of its last character, piece) of each piece that occurs in the characters, by place."""
        codes = self.code[points]
        place = np.flatnonzero(codes)
        node, ends, pieces = np.zeros(len(place), np.int64), [], []
        for k in range(self.longest):
            inside = place + k < len(points)
            place, node = place[inside], node[inside]
            c = codes[place + k]
            to = self.dense[node, c].astype(np.int64)
            odd = np.flatnonzero(c == 127)
            if len(odd) and len(self.rare):
                key = node[odd] << 21 | points[place[odd] + k]
                at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
                to[odd] = np.where(self.rare[at] == key, self.rare_to[at], 0)
            alive = np.flatnonzero(to)
            place, node = place[alive], to[alive]
            if not len(place):
                break
            piece = self.ends[node]
            hit = np.flatnonzero(piece >= 0)
            ends.append(place[hit] + k)
            pieces.append(piece[hit])
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, piece = np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(end, kind="stable")
        return end[order], piece[order]

    def edges(self, words: list[str]):
        """For words with their leading space sign: (sizes, word, start, end, piece), by position. Piece `size` is a lone unknown character."""
        points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.r_[0, np.cumsum(sizes[:-1] + 1)]
        end, piece = self.walk(points)
        spelled = np.zeros(len(points), bool)
        spelled[end[self.length[piece] == 1]] = True
        spelled[firsts + sizes] = True
        alone = np.flatnonzero(~spelled)
        if len(alone):
            end, piece = np.r_[end, alone], np.r_[piece, np.full(len(alone), self.size)]
            order = np.argsort(end, kind="stable")
            end, piece = end[order], piece[order]
        word = np.repeat(np.arange(len(words)), sizes + 1)[end]
        last = end - firsts[word] + 1
        return sizes, word, last - self.length[piece], last, piece

    def forward(self, sizes, word, start, end, chance, rescale: bool = True):
        """alpha[node, model] for the nodes 0..size of each word, with logs taken out on the way: (alpha, base, logs)."""
        base = np.r_[0, np.cumsum(sizes[:-1] + 1)]
        alpha, logs = np.zeros((int((sizes + 1).sum()), chance.shape[1])), np.zeros((len(sizes), chance.shape[1]))
        alpha[base] = 1.0
        order = np.argsort(end.astype(np.uint16) if len(end) and sizes.max() < 65536 else end, kind="stable")  # the edges come by word
        word, start, end, chance = word[order], start[order], end[order], chance[order]
        steps = np.searchsorted(end, np.arange(1, int(sizes.max()) + 2))
        for e in range(1, int(sizes.max()) + 1):
            own = slice(steps[e - 1], steps[e])
            w = word[own]
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[base[w[heads]] + e] = np.add.reduceat(alpha[base[w] + start[own]] * chance[own], heads, axis=0)
            if rescale and e % 16 == 0:
                live = np.flatnonzero(sizes > e)
                if len(live):
                    near = base[live][:, None] + np.arange(max(0, e - self.longest), e + 1)
                    top = alpha[near].max(1)
                    alpha[near] /= top[:, None, :]
                    logs[live] += np.log(top)
        return alpha, base, logs

    def log_likelihood(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, (word, model); chance: (piece, model), already scaled by PER_CHAR a character."""
        sizes, word, start, end, piece = self.edges(words)
        alpha, base, logs = self.forward(sizes, word, start, end, chance[piece])
        return np.log(alpha[base + sizes]) + logs - sizes[:, None] * np.log(PER_CHAR)

    def expected(self, words: list[str], counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur `counts` times, under one model."""
        sizes, word, start, end, piece = self.edges(words)
        own = chance[piece]
        alpha, base, _ = self.forward(sizes, word, start, end, own[:, None], rescale=False)
        alpha, beta = alpha[:, 0], np.zeros(len(alpha))
        beta[base + sizes] = 1.0
        order = np.argsort((LONGEST_TRAINED - start).astype(np.uint16), kind="stable")
        w, s, e, p = word[order], start[order], end[order], own[order]
        most = int(sizes.max())
        steps = np.searchsorted(-s, np.arange(-most, 2))
        for k in range(most):
            part = slice(steps[k], steps[k + 1])
            v = w[part]
            if len(v):
                heads = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                at = most - k
                beta[base[v[heads]] + at] += np.add.reduceat(beta[base[v] + e[part]] * p[part], heads)
        part = slice(steps[most], None)
        v = w[part]
        heads = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        beta[base[v[heads]]] = np.add.reduceat(beta[base[v] + e[part]] * p[part], heads)
        share = alpha[base[word] + start] * own * beta[base[word] + end] / beta[base[word]] * counts[word]
        return np.bincount(piece, share, self.size + 1)


    def expected_long(self, word: str, count: float, chance: np.ndarray) -> np.ndarray:
        """expected() of one word of any length, in logarithms."""
        (size,), _, start, end, piece = self.edges([word])
        own = np.log(chance[piece])
        ahead, behind = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
        ahead[0] = behind[size] = 0.0
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(size + 2))
        for e in range(1, size + 1):
            i = order[cuts[e] : cuts[e + 1]]
            ahead[e] = np.logaddexp.reduce(ahead[start[i]] + own[i])
        order = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[order], np.arange(size + 2))
        for b in range(size - 1, -1, -1):
            i = order[cuts[b] : cuts[b + 1]]
            behind[b] = np.logaddexp.reduce(behind[end[i]] + own[i])
        return np.bincount(piece, np.exp(ahead[start] + own + behind[end] - behind[0]) * count, self.size + 1)


@dataclass
class LanguageModel:
    """chance: (piece, language); its size is bounded by the vocabulary and the languages."""

    path: str
    languages: list[str]
    chance: np.ndarray
    prior: np.ndarray


def scaled(lattice: Lattice, chance: np.ndarray) -> np.ndarray:
    return chance * (PER_CHAR ** lattice.length)[:, None]


def public_prior(path: str) -> np.ndarray:
    """The same first guess for each language: Zipf's law over the vocabulary's own order, which is by merge rank."""
    lattice = Lattice(path)
    known = np.array([lattice.length[i] > 1 or i >= 3 for i in range(lattice.size)])
    guess = np.where(known, 1.0 / (np.arange(lattice.size) + 100.0), 0.0)
    # Single characters stand last in the vocabulary, yet spell all that is left over.
    return np.r_[guess / guess.sum(), UNKNOWN]


#: ASCII letters in lower case; other ASCII signs part words. Other characters stay as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(FOLD).decode().split()


def _expect(batches: Iterator[pa.RecordBatch], path: str, languages: list[str], chance: np.ndarray, held: int) -> Iterator[pa.RecordBatch]:
    lattice, number = per_worker(("lattice", path), lambda: Lattice(path)), {x: i for i, x in enumerate(languages)}
    weights = scaled(lattice, chance)
    sums, counts = np.zeros((len(languages), lattice.size + 1)), [Counter() for _ in languages]

    def spend() -> None:
        for i, own in enumerate(counts):
            words = list(own)
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                short = [w for w in part if len(w) < LONGEST_TRAINED]
                sums[i] += lattice.expected([SPACE + w for w in short], np.array([own[w] for w in short], float), weights[:, i]) if short else 0
                for w in part:
                    if len(w) >= LONGEST_TRAINED:
                        sums[i] += lattice.expected_long(SPACE + w, own[w], weights[:, i])
            own.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[number[lang]].update(words_of(text))
        if sum(map(len, counts)) > held:
            spend()
    spend()
    lang, piece = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[lang, piece])], ["lang", "piece", "n"])


def train(rows: DataFrame, path: str, rounds: int = 1, shared: float = 0.05, guessed: float = 0.02, held_words: int = 200_000) -> LanguageModel:
    """Piece probabilities per language from (text, lang), by expectation-maximisation over all segmentations of all words.

    Each task sums expected counts, so what is shuffled and sent to the driver is bounded by vocabulary times languages.
    `shared` is the weight of the probabilities pooled over languages, which rare pieces fall back to, and `guessed` that of
    the first guess in these. Rows whose lang is
    null are not learned from. Without rows there are no languages and every text is `und`.
    """
    rows = rows.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(seen)
    start = public_prior(path)
    chance = np.repeat(start[:, None], max(1, len(languages)), axis=1)
    for _ in range(rounds if languages else 0):
        given = chance
        sums = rows.mapInArrow(lambda it: _expect(it, path, languages, given, held_words), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        with small_batches(sums.sparkSession):
            sums = sums.toPandas()
        counts = np.zeros_like(chance)
        counts[sums["piece"], sums["lang"]] = sums["n"]
        counts[-1] = 0
        pooled = (1 - guessed) * counts.sum(1) / max(counts.sum(), 1e-9) + guessed * start
        own = counts / np.maximum(counts.sum(0), 1e-9)
        chance = (1 - shared) * own + shared * pooled[:, None]
        chance[-1] = UNKNOWN
    total = sum(seen.values()) or 1
    return LanguageModel(path, languages, chance, np.array([seen[x] / total for x in languages]))


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, remembered: int) -> Iterator[pa.RecordBatch]:
    import regex

    lattice, letter = per_worker(("lattice", model.path), lambda: Lattice(model.path)), regex.compile(r"\p{L}")
    weights, known = scaled(lattice, model.chance), {}
    prior = np.log(model.prior)
    table = np.zeros((0, len(model.languages)))
    for batch in batches:
        lang, score = [], []
        texts = batch.column(batch.num_columns - 1)
        for at in range(0, batch.num_rows, 64):
            split = [words_of(x) if x and model.languages and letter.search(x) else None for x in texts.slice(at, 64).to_pylist()]
            new = list({w for words in split if words for w in words if w not in known})
            if len(known) + len(new) > remembered:
                known.clear()
                table = np.zeros((0, len(model.languages)))
                new = list({w for words in split if words for w in words})
            if new:
                new.sort(key=len)
                parts, part, size = [], [], 0
                for w in new:
                    part.append(SPACE + w)
                    size += len(w)
                    if size > 40_000:
                        parts.append(lattice.log_likelihood(part, weights))
                        part, size = [], 0
                if part:
                    parts.append(lattice.log_likelihood(part, weights))
                known.update(zip(new, range(len(table), 1 << 60)))
                table = np.concatenate([table, *parts])
            for words in split:
                if words is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                total = table[list(map(known.__getitem__, words))].sum(0) + prior
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                lang.append(model.languages[best])
                score.append(float(odds[best] / odds.sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])
    known.clear()
    del table
    release_memory()


def predict(docs: DataFrame, model: LanguageModel, remembered_words: int = 120_000) -> DataFrame:
    """(doc_id, text_key, lang_pred, score): the likeliest language of the whole text and its posterior probability.

    `und` with score 0 where text is null or has no letter, or no language was learned. Ties go to the language that
    sorts first. Words are kept with their likelihoods up to `remembered_words`, then forgotten; that changes no result.
    text_key is the hash of a row's text, which tells rows with the same doc_id apart.
    """
    return keyed(docs).mapInArrow(lambda it: _predict(it, model, remembered_words), "doc_id long, text_key long, lang_pred string, score double")
