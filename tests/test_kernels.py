"""Property checks of the per-row helpers (no Spark)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from qsumm.operators.metric_log import _summary, running_mean_seq
from qsumm.operators.rouge import lcs_length, lcs_length_dp

tokens = st.lists(st.sampled_from(list("abcdef")), max_size=30)


@given(tokens, tokens)
@settings(max_examples=300, deadline=None)
def test_bit_parallel_lcs_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_length_dp(a, b)


@given(tokens, tokens)
@settings(max_examples=100, deadline=None)
def test_lcs_symmetric_and_bounded(a, b):
    n = lcs_length(a, b)
    assert n == lcs_length(b, a)
    assert 0 <= n <= min(len(a), len(b))


@given(tokens)
def test_lcs_self(a):
    assert lcs_length(a, a) == len(a)


values = st.lists(st.floats(min_value=0.0, max_value=30.0, allow_nan=False), min_size=1, max_size=40)


@given(values, values)
@settings(max_examples=200, deadline=None)
def test_chunk_composition_matches_sequential(first, second):
    seq = running_mean_seq(first + second)
    m_in = running_mean_seq(first)[-1]
    a, b, c, z = _summary(second, 0.99, 12.0)
    end = z if m_in == 0 else min(a * m_in + b, c)
    assert abs(end - seq[-1]) <= 1e-9 * max(1.0, abs(seq[-1]))


def test_running_mean_reseed_and_clip():
    assert running_mean_seq([0.0, 5.0]) == [0.0, 5.0]
    assert running_mean_seq([20.0])[0] == 12.0


def test_union_lcs_single_sentence_equals_lcs():
    from qsumm.operators.rouge import union_lcs_counts
    h = [["the", "cat", "sat", "on", "the", "mat"]]
    r = [["the", "cat", "is", "on", "the", "mat"]]
    assert union_lcs_counts(h, r) == (6, 6, lcs_length(h[0], r[0]))


def test_union_lcs_two_reference_lines():
    from qsumm.operators.rouge import union_lcs_counts
    # classic example: r1 = w1 w2 w3 w4 w5, hyp c1 = w1 w2 w6 w7 w8, c2 = w1 w3 w8 w9 w5
    r = [["w1", "w2", "w3", "w4", "w5"]]
    h = [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    n_h, n_r, hits = union_lcs_counts(h, r)
    assert (n_h, n_r) == (10, 5)
    assert hits == 4  # union of {w1 w2} and {w1 w3 w5}


def test_exact_signed_rank_p():
    from qsumm.operators.stats import _exact_two_sided
    # n = 5, all differences positive: T = 0, p = 2 / 32
    assert abs(_exact_two_sided(5, 0) - 0.0625) < 1e-12
    # n = 10, T = 8: P(W <= 8) = 25/1024, two-sided 50/1024
    assert abs(_exact_two_sided(10, 8) - 50 / 1024) < 1e-12
    assert _exact_two_sided(4, 10) == 1.0


def _hits_by_table(ref, hyp):
    """Brute force: the whole table, ties move up first."""
    vals = [[0] * (len(hyp) + 1)]
    for x in ref:
        row = [0]
        for j, y in enumerate(hyp):
            row.append(vals[-1][j] + 1 if x == y else max(vals[-1][j + 1], row[j]))
        vals.append(row)
    mask, i, j = [0] * len(ref), len(ref), len(hyp)
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            mask[i] = 1
        elif vals[i - 1][j] >= vals[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return mask


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_marked_positions_equal_the_table_walk(ref, hyp):
    from qsumm.operators.rouge import _lcs_hits
    mask = [0] * len(ref)
    _lcs_hits(ref, hyp, mask)
    assert mask == _hits_by_table(ref, hyp)


def test_lines_of_ten_thousand_tokens_stay_small():
    import random
    import tracemalloc

    from qsumm.operators.rouge import _lcs_hits, lcs_length
    rng = random.Random(5)
    ref = [str(rng.randrange(500)) for _ in range(10_000)]
    hyp = [str(rng.randrange(500)) for _ in range(10_000)]
    mask = [0] * len(ref)
    tracemalloc.start()
    _lcs_hits(ref, hyp, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(mask) == lcs_length(ref, hyp)
    assert peak < 8 << 20
