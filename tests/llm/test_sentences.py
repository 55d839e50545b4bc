from __future__ import annotations

import textwrap

import pytest

from sievework.llm import sentences as st
from sievework.llm import train_sentences as tr

PROSE = [
    "The council met on Monday to go over the plans that had been sent around in spring.",
    "Nobody had read them, e.g. the part about Dr. Miller and the 3.5 percent that was owed to the harbour.",
    "So the chair asked for another week, and the members agreed to that without a vote.",
    "Will the second meeting bring more than the first one did?",
    "That remains to be seen!",
]


def split(text):
    return [text[a:b] for a, b in st.units(text)]


@pytest.mark.parametrize("width", [40, 64, 72, 80])
def test_wrapped_texts_of_any_width(width):
    text = textwrap.fill(" ".join(PROSE), width)
    assert [" ".join(u.split()) for u in split(text)] == PROSE
    two = text + "\n\n" + textwrap.fill(" ".join(PROSE[::-1]), width)
    assert [" ".join(u.split()) for u in split(two)] == PROSE + PROSE[::-1]


def test_lines_of_sentences_are_not_wrapped():
    assert split("\n".join(PROSE)) == PROSE
    assert split("A heading\n" + "\n".join(PROSE)) == ["A heading", *PROSE]
    assert not st.is_wrapped(["no mark here at all and it goes on", "no mark here at all and it goes on too", "nor here at all in this third line"])


@pytest.mark.parametrize(
    "parts",
    [
        ["هل انتهى التقرير؟", "نعم، انتهى اليوم.", "شكرا لكم!"],
        ["کیا کام ہو گیا؟", "ہاں، ہو گیا۔", "شکریہ۔"],
        ["မင်္ဂလာပါ။", "နေကောင်းလား။", "ကျေးဇူးတင်ပါတယ်။"],
        ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។", "យើងរៀន។"],
        ["መልካም ቀን።", "እንዴት ነህ።", "አመሰግናለሁ።"],
        ["लेखा परीक्षा जरूरी है।", "क्या यह पूरी होगी?", "देर न करें।"],
    ],
)
def test_closing_marks_of_scripts(parts):
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [["การยื่นภาษีต้องเสร็จภายใน 4 วัน", "ฝ่ายบุคคลยังไม่ตอบ", "คณะกรรมการเลื่อนการสอบบัญชีออกไป"], ["ຂ້ອຍໄປຕະຫຼາດ", "ລາວຢູ່ເຮືອນ 2 ຫຼັງ", "ພວກເຮົາຮຽນ"], ["ខ្ញុំទៅផ្សារ", "គាត់នៅផ្ទះ", "យើងរៀន"]])
def test_scripts_whose_sentences_end_at_blanks(parts):
    """Blanks around numbers don't end a sentence: learned, as no rule says so."""
    assert split(" ".join(parts)) == parts


def test_long_chinese_without_any_mark():
    parts = ["实习生终于做完了47份成本核算底稿", "审计收费能在2天内完成吗", "实习生终于做完了56份信息披露底稿", "转让定价能在14天内完成吗", "人事处终于做完了19份成本核算底稿"]
    got = split("".join(parts))
    assert "".join(got) == "".join(parts) and len(set(got) & set(parts)) >= 4
    assert split("转让定价与企业估值的通知") == ["转让定价与企业估值的通知"]


def test_training_learns_from_nothing():
    """Weights start at zero; known ends of held-out lines are found."""
    names = ["Kim", "Lee", "Dr. Han", "Mr. Cho", "Prof. Yun"]
    lines = [f"{n} paid {k}.5 percent to {m} at 9 a.m. on day {k}{c}" for k in range(12) for n, m in zip(names, names[1:]) for c in ".!?"]
    weights = st.train(lines[:100])
    assert st.train([]) == {} and weights
    found = st.accuracy(lines[100:], weights)
    assert all(r > 0.95 and p > 0.95 for r, p in found.values())
    thai = ["การสอบบัญชีต้องเสร็จภายใน 7 วัน", "ผู้สอบบัญชีเลื่อนงานออกไป", "ค่าใช้จ่ายเพิ่มขึ้น 9.1 เท่า", "สำนักงานใหญ่ยังไม่ตอบ"] * 10
    own = st.train(thai)
    score = st.Scorer(own)
    assert score.boundary(("gap", "spaced", "spaced")) > score.boundary(("gap", "spaced", "digit"))


def test_shipped_weights_come_from_training():
    assert len(st.WEIGHTS) > 300 and any(k.startswith("I>B") for k in st.WEIGHTS) and any(k.startswith("joint") for k in st.WEIGHTS)
    score = st.Scorer(st.WEIGHTS)
    assert score.boundary(("gap", "spaced", "spaced")) > 0 > score.boundary(("gap", "spaced", "digit"))


def test_lines_for_training():
    assert tr.lines_of("One is here now.\nTwo came. Three left.\nDr. Four met Inc. Five.\n- a list line.") == ["One is here now.", "Dr. Four met Inc. Five."]
