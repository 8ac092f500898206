"""Session, storage and text helpers that every operator shares."""
