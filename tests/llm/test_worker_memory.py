"""What a Python worker holds: new pieces are contracted in parts, and freed memory goes back before a task."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from faultline.llm import byte_pairs, words


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_new_pieces_are_contracted_in_parts(monkeypatch):
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [" ".join(f"q{i * 7919}xz{i}" for i in range(n, n + 400)) + " " + "ab" * 90 * n for n in (1, 2, 3)]
    whole = byte_pairs.Encoder(ranks, byte_pairs.PATTERN).encode(texts)
    sizes, contract = [], byte_pairs.contract

    def noted(con, todo, *rest):
        sizes.append(len(todo))
        return contract(con, todo, *rest)

    monkeypatch.setattr(byte_pairs, "contract", noted)
    monkeypatch.setattr(byte_pairs, "AT_ONCE", 50, raising=False)
    parts = byte_pairs.Encoder(ranks, byte_pairs.PATTERN).encode(texts)
    assert max(sizes) <= 50 and len(sizes) > 5
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_freed_memory_is_given_back():
    held = [bytearray(60_000) for _ in range(4000)]  # 240 MB in the heap
    last = [bytearray(60_000)]  # keeps the end of the heap in use
    full = resident()
    del held
    words.give_back()
    assert resident() < full - (150 << 20) and last


def test_a_task_gives_back_what_it_held():
    last = []

    def run(batches):
        held = [bytearray(60_000) for _ in range(4000)]  # 240 MB in the heap
        last.append(bytearray(60_000))  # keeps the end of the heap in use
        yield from batches
        last.append(resident())
        del held

    assert list(words.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() < last[1] - (150 << 20)


def letter_words(n: int) -> np.ndarray:
    """Different made-up words, which are no tokens."""
    letters = np.frombuffer(b"qxzvkjwy", np.uint8)
    return letters[(np.arange(n)[:, None] >> (3 * np.arange(7))) & 7].view("S7")[:, 0].astype(str)


def test_pieces_and_runs_of_a_task_are_worked_out_once(monkeypatch):
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [" " + " ".join(part) for part in letter_words(280_000).reshape(4, -1)]
    coder = byte_pairs.Encoder(ranks, byte_pairs.PATTERN)
    back = byte_pairs.Decoder(ranks, coder.con)
    todo, contract = [], byte_pairs.contract

    def noted(con, pieces, *rest):
        todo.extend(pieces)
        return contract(con, pieces, *rest)

    monkeypatch.setattr(byte_pairs, "contract", noted)
    for text in texts * 2:
        ids, size = coder.encode([text])
        decoded = back.decode(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32())))
        assert size.tolist() == [len(ids)] and decoded[0].as_py() == text.encode()
    assert len(todo) == len(set(todo)) and len(todo) > 200_000
