"""Turns of texts that are too long for the JSON parser."""

import hashlib

from vectide.llm.queries import op10_chat_formatting


def test_turn_over_the_limit(spark, tmp_path):
    text = "long text " * 2_000_001
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, None, None), (2, 0, "user", "<|end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op10_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {-1, 1, 2} and (got[1].n_turns, got[2].n_turns) == (3, 1)
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (sha(f"user\nhi\nassistant\n{text}\n\n\n"), len(text), sha(text))
