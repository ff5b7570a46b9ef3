"""claimweave.functions"""
