"""Missing-value rules, recodes and wave arithmetic, as SQL expression text.

A survey has hundreds of columns and every one gets a recode. Text costs nothing to
build and goes to Spark in one call per projection, whereas a Column object costs a
round trip to the JVM per operator. All functions take expressions as text (a column
name is one, see ``nullsafe.quoted``) and return text for ``selectExpr``,
``F.expr`` or SQL; Spark compiles them like any built-in expression.
"""
