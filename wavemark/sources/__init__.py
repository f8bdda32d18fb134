"""Where signals and indexes come from and go to."""
