"""The tagger on sentences it was not trained on, against all taggings, and in the patterns."""

import itertools

import numpy as np
import pytest
from factloom.operators import prefilter, tagger

HELD_OUT = """
The_D supplier_N must_M deliver_V the_D goods_N on_P time_N ._.
Nurses_N may_M quickly_R inform_V the_D patient_N ._.
The_D invoice_N must_M state_V the_D price_N ._.
A_D driver_N must_M be_B rested_V ._.
Members_N must_M renew_V their_D card_N yearly_R ._.
If_C the_D device_N overheats_V ,_. the_D user_N may_M return_V it_O ._.
The_D judge_N reads_V the_D statement_N and_C signs_V it_O ._.
Visitors_N may_M not_X smoke_V ._.
The_D lender_N must_M disclose_V all_D fees_N ._.
An_D auditor_N may_M inspect_V the_D books_N twice_R ._.
The_D cleaner_N must_M wash_V every_D floor_N ._.
A_D tenant_N can_M repair_V the_D door_N ._.
The_D school_N must_M notify_V the_D parents_N before_P the_D trip_N ._.
You_O may_M taste_V it_O ._.
The_D bank_N may_M freeze_V the_D account_N ._.
When_C the_D alarm_N rings_V ,_. leave_V the_D building_N ._.
The_D engine_N was_B repaired_V ._.
Every_D guest_N must_M register_V at_P the_D desk_N ._.
The_D pharmacist_N must_M label_V the_D bottle_N clearly_R ._.
The_D council_N may_M grant_V a_D permit_N ._.
Workers_N must_M wear_V a_D helmet_N ._.
The_D author_N may_M withdraw_V the_D article_N ._.
The_D buyer_N must_M sign_V the_D contract_N ._.
A_D translator_N must_M translate_V each_D sentence_N ._.
The_D carrier_N may_M refuse_V heavy_A boxes_N ._.
"""


def test_accuracy_on_sentences_that_were_held_out():
    model = tagger.default_tagger()
    pairs = [(w, t, g) for s in tagger.read_tagged(HELD_OUT) for (w, t), g in zip(s, model.tag([w for w, _ in s]), strict=True)]
    assert np.mean([t == g for _, t, g in pairs]) > 0.9
    after = [(t == "V", g == "V") for (w, _, _), (_, t, g) in itertools.pairwise(pairs) if w in ("must", "may")]
    assert len(after) > 15 and np.mean([a == b for a, b in after]) > 0.95
    trained = {w.lower() for s in tagger.read_tagged(open(tagger.__file__.replace("tagger.py", "tagged.txt")).read()) for w, _ in s}
    assert np.mean([w.lower() not in trained for w, _, _ in pairs]) > 0.2  # many of the words are new
    unseen = [t == g for w, t, g in pairs if w.lower() not in trained]
    assert np.mean(unseen) > 0.8


def test_leaving_a_tenth_out_of_the_training():
    rows = tagger.read_tagged(open(tagger.__file__.replace("tagger.py", "tagged.txt")).read())
    right = []
    for k in range(10):
        model = tagger.train([s for i, s in enumerate(rows) if i % 10 != k])
        right += [t == g for s in rows[k::10] for (_, t), g in zip(s, model.tag([w for w, _ in s]), strict=True)]
    assert np.mean(right) > 0.75  # 0.78; its sentences are chosen for words of several tags


@pytest.mark.parametrize("words", [["The", "form", "must", "list"], ["users", "may", "zork"], ["7", "blorfed", "!"]])
def test_viterbi_finds_the_best_of_all_taggings(words):
    m = tagger.default_tagger()

    def chance(tags):
        total, prior = 0.0, 0
        for w, t in zip(words, tags, strict=True):
            k = tagger.TAGS.index(t)
            total, prior = total + m.follows[prior, k] + m.scores(w)[k], k + 1
        return total

    best = max(itertools.product(tagger.TAGS, repeat=len(words)), key=chance)
    assert chance(m.tag(words)) == pytest.approx(chance(best))


def test_patterns_by_tags(spark):
    texts = ["The clerk must submit a form. If late, users may delete it.", "It must the end. You may not go.", "May is here.\nThe user shall not wait", "😀 may taste it and must wait", None, "", "the must submit", "MUST SUBMIT and may never delete"]
    rows = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "i int, chunk_text string, must string")
    got = {r.i: r.patterns for r in prefilter.token_patterns(rows).collect()}
    assert got[0] == ["obligation_must_verb", "condition_if_when", "permission_may_verb"]
    assert got[1] == [] and got[2] == ["role_modal", "prohibition_shall_not"] and got[3] == ["permission_may_verb", "obligation_must_verb"]
    assert got[4] == got[5] == [] and "permission_may_verb" not in got[7] and got[7] == ["obligation_must_verb"]
    assert tagger.first_verbs(tagger.default_tagger(), "😀 x may taste", ("must", "may")) == [0, 6]
