import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfghklmnprstw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
                    for _ in range(words))
