"""Source packs: declarative definitions of log sources, and the library of those shipped."""
