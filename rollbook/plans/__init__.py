"""The two phases end to end: build a register, analyse it."""
