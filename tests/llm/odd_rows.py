#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "Word"), (6, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "a b  c d e f\ng"), (None, "a b c d e f g"), (9, "é" * 40 + " \u0000 ▁ <|endoftext|> 日本"), (10, "long " * 60000), (11, "x" * 200000), (None, None)]
