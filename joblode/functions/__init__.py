"""Column functions: keys, places, titles, money, texts."""
