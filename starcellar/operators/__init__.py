"""Building blocks: cleaning, conforming, dimensions, facts, upkeep, ranking."""
