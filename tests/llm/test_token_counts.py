from tests_llm_helpers import rows_of
from tiltml.llm.piece_vocab import BYTE_SCORE, SPACE, vocabulary
from tiltml.llm.queries import QUERIES
from tiltml.llm.token_counts import terminal_counts
from tiltml.llm.token_files import public_tokenizer

VOCAB = vocabulary(public_tokenizer("piece_bpe_32k.model"))


def best_path(word):
    """Viterbi over one word alone."""
    text = SPACE + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - VOCAB.longest), end):
            piece = VOCAB.pieces.get(text[start:end])
            if piece is not None:
                step = (piece[1], 1)
            elif end - start == 1:
                n = len(text[start].encode())
                step = (BYTE_SCORE * n, n)
            else:
                continue
            new = (best[start][0] + step[0], best[start][1] - step[1])
            if best[end] is None or new > best[end]:
                best[end] = new
    return -best[-1][1]


def test_equals_brute_force(spark, tables):
    got = sorted(tuple(map(str, r)) for r in QUERIES["op6_token_counts"](spark, tables).collect())
    want = [(i, len((t or "").split()), sum(map(best_path, (t or "").split()))) for i, t, _ in rows_of(spark, tables)]
    assert got == sorted(tuple(map(str, r)) for r in want)


def test_shared_prefixes():
    words = ["a", "an", "and", "andes", "ba", "b", "and", "日本", "日", SPACE, "x" * 300, "é", "\x07"]
    assert terminal_counts(words, VOCAB) == {w: best_path(w) for w in words}
    assert terminal_counts([], VOCAB) == {}


def test_empty_table(spark, empty_tables):
    assert QUERIES["op6_token_counts"](spark, empty_tables).count() == 0
