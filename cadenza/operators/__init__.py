"""Operators on ordered sequences, repetitions and sets."""
