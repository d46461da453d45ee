"""A model is a function of packed days that returns one point vector per requested forecast."""
