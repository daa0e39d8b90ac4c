"""yieldloom: manufacturing-quality analytics as PySpark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing
is collected unless a docstring says so and names the bound.
"""
