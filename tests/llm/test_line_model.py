"""The line model of problem 6 is estimated from all mails."""

import numpy as np

from lexmill.llm import newtext


def test_all_mails_are_counted(spark):
    mails = [f"Hi Ann,\n\nthe report {i} is ready.\n\nRegards,\nBob" for i in range(3000)]
    for i in range(0, 3000, 40):
        mails[i] = f"> old line {i}\n> more\n\nyes, please do\n\np.s. see you\nSent from my phone"
    rows = spark.createDataFrame(list(enumerate(mails)), "id long, text string").repartition(4)
    (start, step, tables), again = newtext.train(mails)
    _, model = newtext._prepared(rows)
    (got_start, got_step, got_tables), got_again = model.value
    assert np.array_equal(again, got_again) and again.any()
    for got, whole in zip([got_start, got_step, *got_tables], [start, step, *tables], strict=True):
        assert np.allclose(got, whole, rtol=1e-9)


def test_training_tells_notices_by_repetition():
    """A notice nobody described is told by where it stands and how often it recurs; without that it isn't."""
    rng = np.random.default_rng(3)
    words = ["lamp", "garden", "ticket", "meeting", "number", "please", "bring", "the", "to", "office", "later", "with", "paper"]
    say = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    tail = ["Wer dies hier liest ist gebeten worden es niemand", "anderem zu zeigen, sagt unser Haus seit jeher allen."]
    mails, want = [], []
    for i in range(400):
        body = ["Hi Ann,", "", *(say(9) for _ in range(rng.integers(1, 6)))]
        end = ["", "", *tail] if i % 3 == 0 else ["", "Regards,", "Bob Miller"]
        mails.append("\n".join(body + end))
        want.append({k for k, line in enumerate(body) if line})
    model, again = newtext.train(mails)
    runs = [newtext._joined(*newtext.features(m.split("\n")), again) for m in mails]

    def wrong(told):
        return sum(len(w ^ set(np.flatnonzero((p == newtext.NEW) & (r != 0)).tolist())) for p, r, w in zip(newtext.best_paths(runs, told), runs, want, strict=True))

    lines = sum(map(len, want))
    assert wrong(model) <= 0.01 * lines
    untold = newtext.prior()
    untold[2][-1][:] = 1 / 3  # neither training nor a word on repetition
    assert wrong(untold) > 0.05 * lines
